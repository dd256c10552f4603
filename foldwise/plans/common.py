"""Shared pieces of the query catalog: fixture column lists, rounding, SQL helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# obs_events columns
E_NUM = ["value", "x1", "x2", "x3"]
E_CAT = ["c1", "c2"]
E_MISSING = ["x1", "x2", "x3", "c1", "c2"]
E_SCORES = ["value", "s_a", "s_b", "s_c", "x2"]

# obs_orders: role mapping for the canonical domain features
O_NUM = ["n_lines", "qty_total", "qty_a", "qty_n", "qty_r", "price_total", "price_max", "price_min"]
O_CAT = ["c1", "c2"]
O_ROLES = {
    "daily": "qty_total", "social": "qty_a", "gaming": "qty_n", "work": "qty_r",
    "weekend": "price_max", "sleep": "price_min", "notif": "qty_a", "opens": "n_lines",
}

ROUND = 6


def r6(c: Column | str) -> Column:
    """Round to 6 dp on the binary value (x * 1e6 rounded half away from zero).

    ``F.round(x, 6)`` rounds the shortest decimal string of x, which differs from
    DuckDB's binary rounding on exact-looking ties such as 515.6554375.
    """
    c = F.col(c) if isinstance(c, str) else c
    # "+ 0.0" turns a -0.0 into 0.0 (DuckDB keeps the sign of a rounded tiny negative)
    return F.round(c.cast("double") * F.lit(1e6), 0) / F.lit(1e6) + F.lit(0.0)


def sql_r6(expr: str) -> str:
    return f"(round(CAST({expr} AS DOUBLE) * 1e6, 0) / 1e6 + 0.0)"


def sql_div(a: str, b: str) -> str:
    return f"({a}) / NULLIF({b}, 0)"


def sql_isna(c: str) -> str:
    return f"CAST({c} IS NULL AS INTEGER)"


# SQL text of the 15 domain features (oracle side), role names substituted.
DOMAIN_SQL = [
    ("social_media_share", "{social} / NULLIF({daily}, 0)"),
    ("gaming_share", "{gaming} / NULLIF({daily}, 0)"),
    ("work_study_share", "{work} / NULLIF({daily}, 0)"),
    ("entertainment_share", "({social} + {gaming}) / NULLIF({daily}, 0)"),
    ("weekend_weekday_ratio", "{weekend} / NULLIF({daily}, 0)"),
    ("weekend_extra_screen", "{weekend} - {daily}"),
    ("screen_sleep_ratio", "{daily} / NULLIF({sleep}, 0)"),
    ("sleep_awake_share", "{sleep} / NULLIF({sleep} + {daily}, 0)"),
    ("notifications_per_screen_hour", "{notif} / NULLIF({daily}, 0)"),
    ("app_opens_per_screen_hour", "{opens} / NULLIF({daily}, 0)"),
    ("notifications_per_app_open", "{notif} / NULLIF({opens}, 0)"),
    ("engagement_intensity", "({social} + {gaming} + {work}) / NULLIF({daily}, 0)"),
    ("work_sleep_ratio", "{work} / NULLIF({sleep}, 0)"),
    ("app_opens_per_notification", "{opens} / NULLIF({notif}, 0)"),
    ("total_active_hours", "{social} + {gaming} + {work}"),
]


def domain_sql(roles: dict) -> list[str]:
    return [f"{sql_r6(t.format(**roles))} AS {n}" for n, t in DOMAIN_SQL]


def row_stats_sql(cols: list[str], prefix: str = "row_num_") -> tuple[str, list[str]]:
    """(inner select list, outer select list) for row statistics, oracle side."""
    import math
    n = len(cols)
    vs = [f"COALESCE(CAST({c} AS DOUBLE), 0.0)" for c in cols]
    inner = [f"{v} AS _v{i}" for i, v in enumerate(vs)]
    total = "(" + " + ".join(f"_v{i}" for i in range(n)) + ")"
    mean = f"({total} / {float(n)!r})"
    devs = [f"(_v{i} - {mean})" for i in range(n)]
    m2 = "(" + " + ".join(f"{d} * {d}" for d in devs) + ")"
    m3 = "(" + " + ".join(f"{d} * {d} * {d}" for d in devs) + ")"
    m2z = f"(CASE WHEN abs({m2}) < 1e-14 THEN 0.0 ELSE {m2} END)"
    m3z = f"(CASE WHEN abs({m3}) < 1e-14 THEN 0.0 ELSE {m3} END)"
    k = n * math.sqrt(n - 1) / (n - 2)
    outer = [
        f"{sql_r6(mean)} AS {prefix}mean",
        f"{sql_r6(f'sqrt({m2} / {float(n - 1)!r})')} AS {prefix}std",
        f"{sql_r6('greatest(' + ', '.join(f'_v{i}' for i in range(n)) + ')')} AS {prefix}max",
        f"{sql_r6('least(' + ', '.join(f'_v{i}' for i in range(n)) + ')')} AS {prefix}min",
        f"{sql_r6(total)} AS {prefix}sum",
        f"{sql_r6(f'CASE WHEN {m2z} = 0 THEN 0.0 ELSE {k!r} * {m3z} / pow({m2z}, 1.5) END')} AS {prefix}skew",
    ]
    return ", ".join(inner), outer


def sql_safe_corr(a: str, b: str) -> str:
    """Oracle twin of ``exprs.safe_corr``: NULL for a constant side."""
    both = f"({a}) IS NOT NULL AND ({b}) IS NOT NULL"
    ap, bp = f"CASE WHEN {both} THEN {a} END", f"CASE WHEN {both} THEN {b} END"
    return f"(covar_samp({ap}, {bp}) / NULLIF(sqrt(var_samp({ap}) * var_samp({bp})), 0))"


def sql_qcut(x: str, q: int, edge_src: str, cte: str = "_e") -> tuple[tuple[str, str], str]:
    """Oracle qcut: ((cte name, edge CTE body), bin expression).

    The q+1 edges live in a one-row CTE read through scalar subqueries, so the
    oracle needs no join to attach them.  bin = number of distinct interior
    edges below x; NULL for NULL x or a constant column.
    """
    fr = ", ".join(str(i / q) for i in range(q + 1))
    e = f"(SELECT q FROM {cte})"
    terms = " + ".join(
        f"CASE WHEN {e}[{i + 1}] > {e}[{i}] AND {e}[{i + 1}] < {e}[{q + 1}] AND {x} > {e}[{i + 1}] THEN 1 ELSE 0 END"
        for i in range(1, q))
    expr = f"CASE WHEN {x} IS NULL OR {e}[1] = {e}[{q + 1}] THEN NULL ELSE {terms} END"
    return (cte, f"SELECT quantile_cont({x}, [{fr}]) AS q FROM {edge_src}"), expr
