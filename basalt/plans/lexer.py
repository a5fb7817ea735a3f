"""Tokens of the SQL front-end. Characters outside its alphabet are an error."""

from __future__ import annotations

import re
from dataclasses import dataclass

_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<string>'(?:[^']|'')*'|"(?:[^"]|"")*")|(?P<name>[^\W\d]\w*)"""
    r"""|(?P<quoted>`[^`]+`)|(?P<sign><=|>=|<>|!=|==|[()\[\],=<>*+\-/;])"""
)


class SqlError(ValueError):
    """A statement that cannot be read or run."""


@dataclass(frozen=True)
class Token:
    kind: str  # number, string, name, sign, end
    text: str
    quoted: bool = False

    def is_word(self, *words: str) -> bool:
        return self.kind == "name" and not self.quoted and self.text.upper() in words

    def is_sign(self, *signs: str) -> bool:
        return self.kind == "sign" and self.text in signs


def tokenize(text: str) -> list[Token]:
    """Tokens of a statement, an `end` token last."""
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SqlError(f"unexpected character {text[at]!r} at {at}")
        kind, word, at = m.lastgroup, m.group(), m.end()
        if kind == "string":
            out.append(Token("string", word[1:-1].replace(word[0] * 2, word[0])))
        elif kind == "quoted":
            out.append(Token("name", word[1:-1], True))
        elif kind != "space":
            out.append(Token(kind, word))
    return [*out, Token("end", "")]
