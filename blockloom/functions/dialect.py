"""The codec's array expressions as SQL text, in Spark's dialect or ANSI-like SQL with list lambdas.

Arrays are 64 long and row-major. ``let`` binds an array once: Spark would compute a nested array again for each element
that a lambda reads.
"""

from __future__ import annotations


class Spark:
    div = "div"

    def at(self, a: str, i: str) -> str:
        return f"{a}[{i}]"

    def map(self, a: str, v: str, body: str) -> str:
        return f"transform({a}, {v} -> {body})"

    def range(self, n: int) -> str:
        return f"sequence(0, {n - 1})"

    def let(self, x: str, v: str, body: str) -> str:
        return f"transform(array({x}), {v} -> {body})[0]"

    def literal(self, values: list) -> str:
        return "array(" + ", ".join(f"{x!r}D" if isinstance(x, float) else f"{x}L" for x in values) + ")"

    def keep(self, a: str, v: str, body: str) -> str:
        return f"filter({a}, {v} -> {body})"

    size = "size"
    long = "bigint"
    integer = "int"

    def total(self, a: str) -> str:
        return f"aggregate({a}, 0L, (s, x) -> s + x)"

    def shift(self, x: str, n: int) -> str:
        return f"shiftright({x}, {n})"

    def bits(self, x: str) -> str:
        return f"bin({x})"


class Ansi(Spark):
    div = "//"
    size = "len"
    long = "BIGINT"
    integer = "INTEGER"

    def at(self, a: str, i: str) -> str:
        return f"{a}[{i} + 1]"

    def map(self, a: str, v: str, body: str) -> str:
        return f"list_transform({a}, lambda {v}: {body})"

    def range(self, n: int) -> str:
        return f"range(0, {n})"

    def let(self, x: str, v: str, body: str) -> str:
        return f"list_transform([{x}], lambda {v}: {body})[1]"

    def literal(self, values: list) -> str:
        return "[" + ", ".join(f"{x!r}::DOUBLE" if isinstance(x, float) else f"{x}::BIGINT" for x in values) + "]"

    def keep(self, a: str, v: str, body: str) -> str:
        return f"list_filter({a}, lambda {v}: {body})"

    def total(self, a: str) -> str:
        return f"CAST(list_sum({a}) AS BIGINT)"

    def shift(self, x: str, n: int) -> str:
        return f"(({x}) >> {n})"

    def bits(self, x: str) -> str:
        return f"bin({x})"
