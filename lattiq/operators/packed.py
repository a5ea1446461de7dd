"""Several values packed in one field: split into one row per value, with its position.

A finite-state tokenizer walks each field once. Its states are *between* values, inside a *bare* value and inside a
*quoted* value; it also tracks escapes and the depth of brackets. Outside quotes a comma, semicolon, vertical bar or
white space ends a value, unless a round bracket opened inside the value is still open.

Defined results
* null, empty, blank and bracket-only fields give no row; empty values between delimiters (also ``""``) give none.
* positions count from 1 over the values that come out; repeated values stay, each with its own position.
* a quote opens only at the start of a value; it closes before a delimiter, a closing bracket or the end of the
  field. Any other quote of that kind stands for itself; doubled quotes and backslash escapes give one character.
* a quote that is never closed is an ordinary character.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DELIMITERS = frozenset(",;|")
_OPENERS, _CLOSERS = frozenset("[{("), frozenset("]})")
_QUOTES = frozenset("\"'")
_BARE_STOP = re.compile(r"[,;|\s()\[\]{}]")
_QUOTED_STOP = {q: re.compile(rf"[\\{q}]") for q in _QUOTES}
_BRACKET = re.compile(r"[()\[\]{}]")
_CLOSING = {q: re.compile(rf"{q}(?=[,;|\s)\]}}]|$)") for q in _QUOTES}
_SURROGATE = re.compile("[\ud800-\udfff]")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def _matched(text: str) -> set[int]:
    """The places of opening brackets that some bracket closes."""
    waiting, closed = [], set()
    for hit in _BRACKET.finditer(text):
        if hit.group() in _OPENERS:
            waiting.append(hit.start())
        elif waiting:
            closed.add(waiting.pop())
    return closed


def _quoted(text: str, start: int) -> tuple[str, int] | None:
    """The value of the quoted section that opens at start, and the place after it; None if it is never closed."""
    quote, parts, at, end = text[start], [], start + 1, len(text)
    stop = _QUOTED_STOP[quote]
    while hit := stop.search(text, at):
        here = hit.start()
        parts.append(text[at:here])
        following = text[here + 1] if here + 1 < end else ""
        if text[here] == "\\":
            if not following:
                return None
            if following == "u" and re.fullmatch("[0-9a-fA-F]{4}", text[here + 2 : here + 6]):
                parts.append(chr(int(text[here + 2 : here + 6], 16)))
                at = here + 6
            else:
                parts.append(_ESCAPES.get(following, following))
                at = here + 2
        elif following == quote:
            parts.append(quote)
            at = here + 2
        elif not following or following.isspace() or following in _DELIMITERS or following in _CLOSERS:
            value = "".join(parts)
            if _SURROGATE.search(value):  # escapes may spell one character as two
                value = value.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
            return value, here + 1
        else:
            parts.append(quote)
            at = here + 1
    return None


def _bare(text: str, start: int, depth: int, matched: set[int]) -> tuple[str, int]:
    """The bare value that begins at start, and the place after it. Inner round brackets protect delimiters if they close."""
    at, inner = start, 0
    while hit := _BARE_STOP.search(text, at):
        here, char = hit.start(), hit.group()
        if char in _OPENERS:
            inner += here in matched
        elif char in _CLOSERS:
            if inner:
                inner -= 1
            elif depth:
                return text[start:here], here
        elif inner == 0:
            return text[start:here], here
        at = here + 1
    return text[start:], len(text)


def split_packed(text: str | None) -> list[str]:
    """The values packed in text, in order. Time grows in proportion to text, also where nothing that opens is closed."""
    if not text:
        return []
    values, at, end, depth = [], 0, len(text), 0
    matched = _matched(text) if _BRACKET.search(text) else set()
    # beyond the last place where a quote could close, one that opens cannot be closed
    last = {q: max((m.start() for m in _CLOSING[q].finditer(text)), default=-1) for q in _QUOTES if q in text}
    while at < end:
        char = text[at]
        if char in _DELIMITERS or char.isspace():
            at += 1
        elif char in _OPENERS:
            depth, at = depth + 1, at + 1
        elif char in _CLOSERS and depth:
            depth, at = depth - 1, at + 1
        else:
            got = _quoted(text, at) if char in _QUOTES and at < last[char] else None
            value, at = got or _bare(text, at, depth, matched)
            if value := value.strip():
                values.append(value)
    return values


@F.pandas_udf(T.ArrayType(T.StringType()))
def _split_column(fields: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in fields:
        yield batch.map(split_packed)


def explode_packed(rows: DataFrame, field: str | Column, pos: str = "pos", value: str = "value") -> DataFrame:
    """rows, once for each value packed in field, with the 1-based position and the value. No shuffle; columns of rows stay.

    pos and value must not be names of columns of rows; a clash raises ValueError rather than giving an ambiguous result.
    """
    if clash := {pos, value} & set(rows.columns):
        raise ValueError(f"rows already has {sorted(clash)}")
    column = F.col(field) if isinstance(field, str) else field
    packed = rows.select("*", _split_column(column.cast("string")).alias("__values"))
    return packed.select(*[F.col(f"`{c}`") for c in rows.columns], F.posexplode("__values").alias(pos, value)).withColumn(pos, F.col(pos) + 1)
