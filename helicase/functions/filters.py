"""Filter conditions as screens are used to write them, turned into Spark conditions.

    P > 0.9 and (z < -4 or N >= 6) and seqID =~ /^chr[0-9]+$/

Words are told apart and each is put in Spark SQL's own terms; the grammar and
the pushdown are Spark's.  Nothing but the fields, numbers, quoted text, patterns
and operators below gets through, so a condition can't call anything.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.reports import HIT_COLUMNS

#: The column of a field by any of its names: the file format's, ours, and those that older texts use.
FIELDS = {form: own for own, form in HIT_COLUMNS.items()} | {own: own for own in HIT_COLUMNS} | {
    "hitID": "window_id", "locusID": "locus_id"}
_FOLDED = {name.lower(): column for name, column in FIELDS.items()}
#: Operators on numbers, on text, and between conditions, with what they are in SQL.
_SIGNS = {"==": "=", "!=": "<>", "<=": "<=", ">=": ">=", "<": "<", ">": ">", "&&": "AND", "||": "OR", "!": "NOT",
          "+": "+", "-": "-", "*": "*", "/": "/", "(": "(", ")": ")"}
_TEXT_SIGNS = {"eq": "=", "ne": "<>", "lt": "<", "gt": ">", "le": "<=", "ge": ">="}
_LINKS = {"and": "AND", "or": "OR", "not": "NOT"}
_TOKEN = re.compile(r"""
    (?P<space>\s+) | (?P<number>(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?) | (?P<text>"(\\.|[^"\\])*"|'(\\.|[^'\\])*')
    | (?P<word>[A-Za-z_][A-Za-z_0-9]*) | (?P<match>=~|!~) | (?P<sign>==|!=|<=|>=|&&|\|\||[<>!+\-*/()])""", re.X)
_PATTERN = re.compile(r"\s*m?/((?:\\.|[^/\\])*)/(i?)")


class FilterError(ValueError):
    """What is wrong with a condition, and where: ``position`` counts characters from 0."""

    def __init__(self, what: str, text: str, position: int):
        super().__init__(f"{what} at {position}: {text[:position]} >>> {text[position:]}")
        self.position = position


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _field(word: str) -> str | None:
    """A field by name, in its own spelling or any case, or by number: ``COL1`` is the first."""
    if word in FIELDS:
        return FIELDS[word]
    numbered = re.fullmatch(r"COL(\d+)", word)
    if numbered and 1 <= int(numbered[1]) <= len(HIT_COLUMNS):
        return list(HIT_COLUMNS)[int(numbered[1]) - 1]
    return _FOLDED.get(word.lower())


def filter_sql(text: str) -> str:
    """The condition in Spark SQL; a :class:`FilterError` says what can't be understood and where."""
    out: list[str] = []
    depth, at, operand = [], 0, False
    # signs bind closer than words: what && and || join between two words is one part of them
    runs = [[0, False]]  # at each depth: where the part begins, and whether signs join it

    def close_run() -> None:
        begins, joined = runs[-1]
        if joined:
            out.insert(begins, "(")
            out.append(")")

    def expect(needs_operand: bool, found: str) -> None:
        if needs_operand != operand:
            raise FilterError(f"{found} where {'a value' if not operand else 'an operator'} is expected", text, at)

    while at < len(text):
        token = _TOKEN.match(text, at)
        if not token:
            raise FilterError("unknown sign", text, at)
        kind, word = token.lastgroup, token[0]
        if kind is None or kind == "space":
            at = token.end()
            continue
        end = token.end()
        if kind == "number":
            expect(False, f"number {word}")
            out.append(f"{float(word)!r}D" if not word.isdigit() else word)
            operand = True
        elif kind == "text":
            expect(False, "text")
            out.append(_quoted(re.sub(r"\\(.)", r"\1", word[1:-1])))
            operand = True
        elif kind == "match":
            expect(True, word)
            pattern = _PATTERN.match(text, end)
            if not pattern:
                raise FilterError("no /pattern/ follows", text, end)
            body = pattern[1].replace("\\/", "/")
            try:
                re.compile(body)
            except re.error as problem:
                raise FilterError(f"pattern: {problem}", text, end) from None
            # a pattern binds closer than NOT, so it is denied as a whole
            out.append(f"{'NOT ' if word == '!~' else ''}RLIKE {_quoted(('(?i)' if pattern[2] else '') + body)}")
            end, operand = pattern.end(), True
        elif kind == "word" and word.lower() in _LINKS:
            link = _LINKS[word.lower()]
            expect(link != "NOT", word)
            close_run()
            out.append(link)
            runs[-1] = [len(out), False]
            operand = False
        elif kind == "word" and word in _TEXT_SIGNS and operand:
            out.append(_TEXT_SIGNS[word])
            operand = False
        elif kind == "word":
            column = _field(word)
            if column is None:
                raise FilterError(f"no field {word}", text, at)
            expect(False, f"field {word}")
            out.append(f"`{column}`")
            operand = True
        elif word == "(":
            expect(False, word)
            depth.append(at)
            out.append(word)
            runs.append([len(out), False])
        elif word == ")":
            expect(True, word)
            if not depth:
                raise FilterError("nothing is open", text, at)
            depth.pop()
            close_run()
            runs.pop()
            out.append(word)
        elif word in ("!",) or word in "+-" and not operand:
            expect(False, word)
            out.append(_SIGNS[word])
        else:
            expect(True, word)
            out.append(_SIGNS[word])
            runs[-1][1] |= word in ("&&", "||")
            operand = False
        at = end
    if depth:
        raise FilterError("not closed", text, depth[-1])
    if not operand:
        raise FilterError("a value is expected", text, len(text))
    close_run()
    return " ".join(out)


def filter_column(text: str) -> Column:
    """The condition as a column over the fields of hits, pushed down like any other.

    ``==`` and its kin compare numbers, ``eq`` and its kin text; ``=~`` and
    ``!~`` take a pattern between slashes.  A condition that is no comparison
    is an error when the query is analysed.
    """
    return F.expr(filter_sql(text))
