"""Small helpers to write the check SQL of a query."""

from __future__ import annotations


def check(ctes: list[str], body: str, plain: str = "", rounded: str = "", digits: int = 6,
          special: dict[str, int] | None = None) -> str:
    """``WITH ctes SELECT plain columns, round(doubles) FROM (body)``; columns are space-separated names."""
    special = special or {}
    cols = plain.split() + [f"round(CAST({c} AS DOUBLE), {special.get(c, digits)}) + 0.0 AS {c}" for c in rounded.split()]
    head = f"WITH {', '.join(ctes)} " if ctes else ""
    return f"{head}SELECT {', '.join(cols)} FROM ({body}) q"
