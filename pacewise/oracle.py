"""DuckDB oracle SQL for every registered query.

The oracle restates the bindings and each operator independently in ANSI SQL
(DuckDB dialect) over the pre-registered views of the given tables. Shared
steps are named CTEs; ``sql(final, needs...)`` emits a WITH clause holding the
transitive dependencies in definition order. Portability rules (SURVEY §2.17):
guarded division, doubles instead of decimal literals, half-up rounding by
floor(x*10^n+0.5)/10^n, money and averages summed as fixed-scale decimals,
integer sums cast to BIGINT.
"""

from __future__ import annotations

AS_OF = "TIMESTAMP '1999-07-01 00:00:00'"
AS_OF_D = "DATE '1999-07-01'"

_CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, deps: list[str], body: str) -> None:
    _CTES[name] = (deps, body)


def sql(final: str, *needs: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in _CTES[n][0]:
            visit(d)
        order.append(n)

    for n in needs:
        visit(n)
    if not order:
        return final
    parts = [f"{n} AS (\n{_CTES[n][1]}\n)" for n in order]
    return "WITH " + ",\n".join(parts) + "\n" + final


def rnd(expr: str, n: int) -> str:
    scale = f"{10 ** n}.0"
    return f"(CAST(floor(CAST({expr} AS DOUBLE) * CAST({scale} AS DOUBLE) + 0.5) AS DOUBLE) / CAST({scale} AS DOUBLE))"


def dbl(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


def lst(values: list, idx: str) -> str:
    items = ", ".join("'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else
                      ("true" if v is True else "false" if v is False else str(v)) for v in values)
    return f"([{items}])[CAST(({idx}) % {len(values)} AS INTEGER) + 1]"


def cnt_if(cond: str) -> str:
    return f"CAST(SUM(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT)"


def xavg(expr: str, scale: int = 10) -> str:
    d = f"CAST({expr} AS DECIMAL(28,{scale}))"
    return f"(CASE WHEN COUNT({d}) > 0 THEN CAST(SUM({d}) AS DOUBLE) / COUNT({d}) END)"


def digits(k: str) -> str:
    """The number with leading zeros up to seven digits, never shortened."""
    text = f"CAST({k} AS VARCHAR)"
    return f"(repeat('0', greatest(0, 7 - length({text}))) || {text})"


def camp_key(k: str) -> str:
    return f"('CMP-' || {digits(k)})"
