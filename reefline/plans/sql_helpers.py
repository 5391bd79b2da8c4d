"""SQL (DuckDB) building blocks for the oracle queries."""

from __future__ import annotations

from collections.abc import Sequence

from reefline.sqltext import sql_lit


def quantiles_sql(src: str, keys: Sequence[str], col: str, probs: Sequence[float], names: Sequence[str]) -> str:
    """Type-7 quantiles per group from explicit order statistics:
    ``lo`` if the neighbours are equal or the position is whole, else ``(1-g)*lo + g*hi``."""
    keys = list(keys)
    kl = ", ".join(keys)
    part = f"PARTITION BY {kl}" if keys else ""
    inner = (f"SELECT {kl + ', ' if keys else ''}v, row_number() OVER ({part} ORDER BY v) - 1 AS k, "
             f"count(*) OVER ({part}) AS n FROM (SELECT {kl + ', ' if keys else ''}{col} AS v FROM {src} "
             f"WHERE {col} IS NOT NULL)")
    aggs, outs = [], []
    for i, p in enumerate(probs):
        h = f"((n - 1) * {sql_lit(float(p))})"
        aggs.append(f"any_value({h}) AS h{i}")
        aggs.append(f"max(CASE WHEN k = floor({h}) THEN v END) AS lo{i}")
        aggs.append(f"max(CASE WHEN k = ceil({h}) THEN v END) AS hi{i}")
        g = f"(h{i} - floor(h{i}))"
        outs.append(f"CASE WHEN {g} = 0 OR lo{i} = hi{i} THEN lo{i} ELSE (1 - {g}) * lo{i} + {g} * hi{i} END AS {names[i]}")
    group = f"GROUP BY {kl}" if keys else ""
    return (f"SELECT {kl + ', ' if keys else ''}{', '.join(outs)} FROM "
            f"(SELECT {kl + ', ' if keys else ''}{', '.join(aggs)} FROM ({inner}) {group})")


def scalar_quantile_sql(src: str, col: str, p: float) -> str:
    return f"(SELECT q FROM ({quantiles_sql(src, [], col, [p], ['q'])}))"
