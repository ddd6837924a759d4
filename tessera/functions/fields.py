"""A field-query language as a filter: field:value, ranges, comparisons, lists, AND, OR, NOT and parentheses.

    issuer.symbol:ABC AND filedAt:[2024-01-01 TO 2024-12-31] AND NOT (code:(S OR F) OR shares:>1000)

Fields may lead through structs and arrays of structs; a condition on an array holds if any element meets it.
A value in double quotes may hold blanks; `*` alone means that the field is there, and at the end of a value it
stands for any rest. Null fields meet no condition, and NOT of that holds.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, NumericType, StructType

_TOKEN = re.compile(r'\s*(?:(\()|(\))|\b(AND|OR|NOT)\b|([\w.]+):|\[\s*([^\]]+?)\s+TO\s+([^\]]+?)\s*\]|(>=|<=|>|<)\s*([^\s()]+)|"([^"]*)"|([^\s()]+))')


def _resolve(path: list[str], kind: DataType, at: Column, test: Callable[[Column, DataType], Column]) -> Column:
    """The test on a field, in any element where the path leads through an array."""
    if isinstance(kind, ArrayType):
        return F.exists(at, lambda x: _resolve(path, kind.elementType, x, test))
    if not path:
        return F.coalesce(test(at, kind), F.lit(False))
    if not isinstance(kind, StructType) or path[0] not in kind.names:
        raise ValueError(f"no such field: {path[0]}")
    return _resolve(path[1:], kind[path[0]].dataType, at[path[0]], test)


class _Reader:
    def __init__(self, text: str, schema: StructType) -> None:
        self.tokens = [m.groups() for m in _TOKEN.finditer(text) if m[0].strip()]
        self.schema, self.at = schema, 0

    def peek(self) -> tuple | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self) -> tuple:
        token = self.peek()
        if token is None:
            raise ValueError("the query ends too early")
        self.at += 1
        return token

    def either(self) -> Column:
        out = self.both()
        while (t := self.peek()) and t[2] == "OR":
            self.take()
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.one()
        while (t := self.peek()) and t[2] == "AND":
            self.take()
            out = out & self.one()
        return out

    def one(self) -> Column:
        token = self.take()
        if token[2] == "NOT":
            return ~self.one()
        if token[0]:
            out = self.either()
            if not self.take()[1]:
                raise ValueError("a parenthesis is missing")
            return out
        if not token[3]:
            raise ValueError(f"a field is missing before {next(x for x in token if x)}")
        name, *path = token[3].split(".")
        if name not in self.schema.names:
            raise ValueError(f"no such field: {name}")
        test = self.test()
        return _resolve(path, self.schema[name].dataType, F.col(f"`{name}`"), test)

    def test(self) -> Callable[[Column, DataType], Column]:
        token = self.take()
        if token[0]:  # a list of values
            tests = [self.test()]
            while (t := self.take())[2] == "OR":
                tests.append(self.test())
            if not t[1]:
                raise ValueError("a parenthesis is missing")
            return lambda c, kind: F.coalesce(*[F.when(x(c, kind), F.lit(True)) for x in tests], F.lit(False))
        _, _, _, _, low, high, sign, bound, quoted, plain = token
        if low is not None:
            return lambda c, kind: (F.lit(low == "*") | (c >= self.value(low, kind))) & (F.lit(high == "*") | (c <= self.value(high, kind)))
        if sign:
            return lambda c, kind: {">": c > self.value(bound, kind), "<": c < self.value(bound, kind), ">=": c >= self.value(bound, kind), "<=": c <= self.value(bound, kind)}[sign]
        if quoted is None and plain == "*":
            return lambda c, _: c.isNotNull()
        if quoted is None and plain.endswith("*"):
            return lambda c, _: F.startswith(c.cast("string"), F.lit(plain[:-1]))
        return lambda c, kind: c == self.value(plain if quoted is None else quoted, kind)

    @staticmethod
    def value(text: str, kind: DataType) -> Column:
        if isinstance(kind, NumericType):
            return F.lit(text).try_cast("double")
        return F.lit(text) if text != "*" else F.lit(None).cast("string")


def field_query(text: str, schema: StructType) -> Column:
    """The condition that a query states on rows of this schema; what can't be read raises a ValueError."""
    reader = _Reader(text, schema)
    if not reader.tokens:
        return F.lit(True)
    out = reader.either()
    if reader.peek():
        raise ValueError("more than one condition without AND or OR")
    return out
