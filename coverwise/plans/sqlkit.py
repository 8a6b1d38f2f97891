"""Assemble DuckDB oracle statements from named common table expressions.

Each CTE is registered once with its dependencies; ``statement`` pulls in the
transitive closure in dependency order. This is string assembly only: the
oracle side exists to check the Spark plans, it is not an execution path.
"""
from __future__ import annotations

_CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, body: str, *deps: str) -> str:
    _CTES[name] = (body.strip(), deps)
    return name


def statement(select: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in _CTES[n][1]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return select.strip()
    parts = [f"{n} AS (\n{_CTES[n][0]}\n)" for n in order]
    return "WITH " + ",\n".join(parts) + "\n" + select.strip()
