"""Building blocks: named subqueries and the scalar rules used in all of them."""

from __future__ import annotations

import re

# name -> SQL of the subquery; a subquery may use any other by name.
PARTS: dict[str, str] = {}


def r2(x: str) -> str:
    return f"round(cast({x} as decimal(38,10)), 2)"


def q(a: str, b: str) -> str:
    return f"cast(({a}) / nullif({b}, 0) as decimal(28,10))"


def m(x: str) -> str:
    return f"cast({x} as decimal(18,2))"


def avg(x: str) -> str:
    return m(r2(q(f"sum({x})", f"count({x})")))


def pct(a: str, b: str) -> str:
    return m(r2(f"{q(a, b)} * 100"))


def initcap(x: str) -> str:
    """For text whose words are split by spaces only."""
    return (
        f"array_to_string(list_transform(string_split({x}, ' '), "
        "lambda w: upper(w[1]) || lower(w[2:])), ' ')"
    )


def label(x: str) -> str:
    return initcap(f"replace({x}, '_', ' ')")


def days(a: str, b: str) -> str:
    return f"date_diff('day', {b}, {a})"


def steps(x: str, pairs: list[tuple[object, object]], otherwise: object, op: str = ">=") -> str:
    def lit(v: object) -> str:
        return f"'{v}'" if isinstance(v, str) else str(v)

    whens = " ".join(f"when {x} {op} {bound} then {lit(v)}" for bound, v in pairs)
    return f"case {whens} else {lit(otherwise)} end"


def _used(sql: str) -> list[str]:
    words = set(re.findall(r"[a-z_][a-z0-9_]*", sql))
    return [name for name in PARTS if name in words]


def statement(select: str) -> str:
    """``select`` with all subqueries it needs, in order of use."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for other in _used(PARTS[name]):
            if other != name:
                visit(other)
        ordered.append(name)

    for name in _used(select):
        visit(name)
    if not ordered:
        return select
    body = ",\n".join(f"{name} as (\n{PARTS[name].strip()}\n)" for name in ordered)
    return f"with {body}\n{select}"


def typed(source: str, doubles: str = "", bigints: str = "", skip: str = "") -> str:
    """All columns of ``source`` with fixed output types."""
    swaps = [f"cast({c} as double) as {c}" for c in doubles.split()]
    swaps += [f"cast({c} as bigint) as {c}" for c in bigints.split()]
    out = "*"
    if skip:
        out += f" exclude ({', '.join(skip.split())})"
    if swaps:
        out += f" replace ({', '.join(swaps)})"
    return statement(f"select {out} from {source}")
