"""Rendering Python literals as SQL text (used for oracle queries in tests)."""

from __future__ import annotations


def sql_str(s: str | None) -> str:
    """Quoted SQL string; control characters are spliced in with ``chr``."""
    if s is None:
        return "NULL"
    parts: list[str] = []
    buf = ""
    for ch in s:
        if ord(ch) < 32:
            parts.append("'" + buf.replace("'", "''") + "'")
            parts.append(f"chr({ord(ch)})")
            buf = ""
        else:
            buf += ch
    parts.append("'" + buf.replace("'", "''") + "'")
    parts = [p for p in parts if p != "''"] or ["''"]
    return parts[0] if len(parts) == 1 else "(" + " || ".join(parts) + ")"


def sql_lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return f"CAST({float(v)!r} AS DOUBLE)" if isinstance(v, float) else str(v)
    return sql_str(v)


def sql_in_list(values) -> str:
    return "(" + ", ".join(sql_lit(v) for v in values if v is not None) + ")"


def sql_case(expr: str, pairs, default: str = "NULL") -> str:
    """``CASE expr WHEN k THEN v ... ELSE default END``."""
    whens = " ".join(f"WHEN {sql_lit(k)} THEN {sql_lit(v)}" for k, v in pairs if k is not None)
    return f"CASE {expr} {whens} ELSE {default} END"
