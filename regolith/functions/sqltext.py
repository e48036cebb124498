"""Text of SQL expressions over triples, for the oracle queries."""

from __future__ import annotations

T3 = tuple[str, str, str]


def v(*names: str) -> T3:
    return names  # type: ignore[return-value]


def sub(a: T3, b: T3) -> T3:
    return tuple(f"({x} - {y})" for x, y in zip(a, b, strict=True))  # type: ignore[return-value]


def dot(a: T3, b: T3) -> str:
    return "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b, strict=True)) + ")"


def cross(a: T3, b: T3) -> T3:
    return f"({a[1]} * {b[2]} - {a[2]} * {b[1]})", f"({a[2]} * {b[0]} - {a[0]} * {b[2]})", f"({a[0]} * {b[1]} - {a[1]} * {b[0]})"


def norm(a: T3) -> str:
    return f"sqrt({dot(a, a)})"


def apply(prefix: str, a: T3) -> T3:
    return tuple(dot((f"{prefix}{i}0", f"{prefix}{i}1", f"{prefix}{i}2"), a) for i in range(3))  # type: ignore[return-value]


def apply_back(prefix: str, a: T3) -> T3:
    return tuple(dot((f"{prefix}0{i}", f"{prefix}1{i}", f"{prefix}2{i}"), a) for i in range(3))  # type: ignore[return-value]


def micro(e: str) -> str:
    return f"cast(floor(({e}) * 1e6::double + 0.5::double) as bigint)"


def floor(e: str) -> str:
    return f"cast(floor({e}) as bigint)"
