import pytest

from basalt.plans import ast
from basalt.plans.lexer import SqlError, tokenize
from basalt.plans.parser import parse


def test_create_table_keeps_columns_types_and_indexes():
    s = parse("CREATE TABLE Restaurantes (id INT INDEX isam, nombre VARCHAR[20] INDEX btree, fecha DATE, u ARRAY[FLOAT])")
    assert s.table == "restaurantes"
    assert [(c.name, str(c.type), c.index) for c in s.columns] == [("id", "INT", "isam"), ("nombre", "VARCHAR[20]", "btree"), ("fecha", "DATE", None), ("u", "ARRAY[FLOAT]", None)]


def test_types_in_other_spellings():
    s = parse("create table t (a VARCHAR(7), b CHAR[3], c whatever, d CHAR)")
    assert [str(c.type) for c in s.columns] == ["VARCHAR[7]", "VARCHAR[3]", "VARCHAR[100]", "VARCHAR[100]"]


def test_insert_separates_values_at_commas_and_keeps_signs_and_case():
    s = parse("INSERT INTO Restaurantes VALUES (-1, 'KFC, Lima = 1', 2.5, [1, -2.5])")
    assert s.rows == ((-1, "KFC, Lima = 1", 2.5, [1, -2.5]),)


def test_select_with_all_clauses():
    s = parse("SELECT city, COUNT(*) AS total FROM users WHERE age > 30 USING btree GROUP BY city ORDER BY total DESC LIMIT 10;")
    assert (s.table, s.using, s.group_by, s.order_by, s.limit) == ("users", "btree", ("city",), (("total", True),), 10)
    assert s.items[1].count and s.items[1].alias == "total"


def test_not_equal_and_precedence():
    s = parse("SELECT * FROM t WHERE a != 1 OR b <> 2 AND NOT c = 3")
    assert isinstance(s.where, ast.Logical) and s.where.word == "OR"
    assert s.where.right.word == "AND"


@pytest.mark.parametrize(
    "text, says",
    [
        ("", "empty"), ("UPDATE t SET a = 1", "unsupported statement"), ("SELECT a", "expected FROM"), ("DELETE FROM t", "expected WHERE"),
        ("SELECT * FROM t LIMIT x", "whole number"), ("CREATE TABLE t", "must define columns"), ("SELECT * FROM t WHERE a ~ 1", "unexpected character"),
        ("SELECT * FROM t nonsense", "unexpected"), ("CREATE TABLE t (a INT, a INT)", "repeats"), ("SELECT * FROM t USING magic", "unknown index kind"),
    ],
)
def test_errors(text, says):
    with pytest.raises(SqlError, match=says):
        parse(text)


def test_tokens_of_strings_and_quoted_names():
    kinds = [(t.kind, t.text) for t in tokenize("""`country/region` = "Li""ma" 'it''s' """)]
    assert kinds == [("name", "country/region"), ("sign", "="), ("string", 'Li"ma'), ("string", "it's"), ("end", "")]
