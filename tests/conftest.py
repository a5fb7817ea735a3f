import os

import pytest

os.environ.setdefault("OMP_NUM_THREADS", "2")

from basalt.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(cores=4, memory="4g", shuffle_partitions=4)


@pytest.fixture
def engine(spark, tmp_path):
    from basalt.plans.engine import Engine

    return Engine(spark, str(tmp_path / "tables"))
