"""SQL (DuckDB dialect) twin of the review pipeline, used as the correctness oracle.

It is written step by step from the same fixed values, but with SQL's own
mechanisms (CASE chains, window ``row_number``, EXISTS) instead of the Spark
operators' literal maps, null-safe joins and bucketed positions.
"""

from __future__ import annotations

from reefline import fixed_values as fv
from reefline.functions.numeric import NUMBER_PATTERN
from reefline.sources.bindings import LINEITEM_ORDER, sql_views
from reefline.sqltext import sql_in_list, sql_lit, sql_str

ORDER_SQL = ", ".join(f"{c} ASC NULLS FIRST" for c in LINEITEM_ORDER)


def in_set(col: str, values) -> str:
    """Never-NULL membership (a None member matches NULL)."""
    vals = [v for v in values if v is not None]
    base = f"COALESCE({col} IN {sql_in_list(vals)}, FALSE)" if vals else "FALSE"
    return f"({base} OR {col} IS NULL)" if any(v is None for v in values) else base


def not_contains(col: str, pattern: str) -> str:
    return f"NOT COALESCE(contains({col}, {sql_str(pattern)}), FALSE)"


def convert(value: str, unit: str, rules) -> str:
    seen, whens = set(), []
    for k, f in rules:
        if k not in seen:
            seen.add(k)
            whens.append(f"WHEN {sql_str(k)} THEN {value} * {sql_lit(float(f))}")
    return f"CASE {unit} " + " ".join(whens) + " END"


def patched(patches, columns, key: str = "paper_name") -> str:
    """``* REPLACE (...)`` list applying ordered keyed patches (last match wins)."""
    by_col: dict[str, list] = {}
    for c, v, keys in patches:
        by_col.setdefault(c, []).append((v, keys))
    parts = []
    for c, lst in by_col.items():
        whens = " ".join(f"WHEN {in_set(key, keys)} THEN {sql_lit(v)}" for v, keys in reversed(lst))
        parts.append(f"CASE {whens} ELSE {c} END AS {c}")
    return ", ".join(parts)


def taxon(species: str = "species") -> str:
    w1 = f"string_split({species}, ' ')[1]"
    w2 = f"string_split({species}, ' ')[2]"
    return f"{w1} AS genus", f"COALESCE({w1}, 'NA') || '_' || COALESCE({w2}, 'NA')"


def nonneg(col: str) -> str:
    return f"({col} >= 0 AND NOT isnan({col}))"


def positional(target: str, values: dict, key: str = "paper_name") -> str:
    parts = []
    for c, vals in values.items():
        arr = "[" + ", ".join(sql_lit(str(v)) if c == "error" else sql_lit(float(v)) for v in vals) + "]"
        parts.append(f"CASE WHEN {key} = {sql_str(target)} THEN {arr}[((rn - 1) % {len(vals)}) + 1] ELSE {c} END AS {c}")
    return ", ".join(parts)


def review_ctes() -> list[tuple[str, str]]:
    """Ordered CTEs ending in ``growth`` (the unified table) and the branch tables."""
    v = sql_views()
    fam_pairs = [(s, fam) for fam, lst in fv.METHOD_FAMILIES.items() for s in lst]
    fam_case = "CASE method " + " ".join(f"WHEN {sql_str(s)} THEN {sql_str(f)}" for s, f in fam_pairs) + " END"
    dropped = " AND ".join(f"COALESCE(method, 'NA') <> {sql_str(m)}" for m in fv.DROPPED_METHODS)
    genus, species = taxon()
    ctes = [("rates", v["rates"]), ("extra", v["extra"])]
    ctes.append(("prepared", f"SELECT * REPLACE (COALESCE(method, 'NA') AS method), COALESCE({fam_case}, 'NA') AS method_family "
                             f"FROM rates WHERE {dropped}"))
    # biomass
    ctes.append(("b0", f"SELECT * REPLACE (CASE WHEN {in_set('unit', fv.BIOMASS_TO_CANONICAL)} THEN "
                       f"{sql_str(fv.CANONICAL_BIOMASS)} ELSE unit END AS unit) FROM prepared WHERE {in_set('unit', fv.BIOMASS_UNITS)}"))
    ctes.append(("b1", f"SELECT *, {convert('rate', 'unit', fv.BIOMASS_RATE_RULES)} AS rate_std FROM b0 WHERE {not_contains('unit', 'wet')}"))
    ctes.append(("b2", f"SELECT * REPLACE (CASE WHEN {in_set('paper_name', fv.BIOMASS_DAY_NOT_HOUR)} THEN rate_std / 24.0 "
                       f"ELSE rate_std END AS rate_std) FROM b1 WHERE "
                       + " AND ".join(f"paper_name <> {sql_str(p)}" for p in fv.BIOMASS_EXCLUDED)))
    ctes.append(("b3", f"SELECT * REPLACE (NULLIF(method_family, 'NA') AS method_family, NULLIF(climate, 'NA') AS climate, "
                       f"{species} AS species), {genus} FROM b2 WHERE {nonneg('rate_std')}"))
    ctes.append(("biom", f"SELECT * REPLACE ({patched(fv.BIOMASS_PATCHES, None)}) FROM b3"))
    # volume
    ctes.append(("v0", f"SELECT * REPLACE ({sql_str(fv.VOLUME_FAMILY)} AS method_family), "
                       f"{convert('rate', 'unit', fv.VOLUME_RATE_RULES)} AS rate_std FROM prepared WHERE unit = {sql_str(fv.VOLUME_UNIT)}"))
    ctes.append(("vol", f"SELECT * REPLACE ({patched(fv.VOLUME_PATCHES, None)}, {species} AS species), {genus} FROM v0"))
    # surface
    tgt, vals = fv.SURFACE_POSITIONAL
    ctes.append(("s0", f"SELECT * REPLACE (CASE WHEN {in_set('unit', fv.SURFACE_TO_CANONICAL)} THEN {sql_str(fv.CANONICAL_SURFACE)} "
                       f"ELSE unit END AS unit), row_number() OVER (PARTITION BY paper_name ORDER BY {ORDER_SQL}) AS rn "
                       f"FROM prepared WHERE {in_set('unit', fv.SURFACE_UNITS)} AND rate IS NOT NULL AND "
                       f"{not_contains('species', chr(34) + 'CCA' + chr(34))} AND {not_contains('species', 'CCA')}"))
    ctes.append(("s1", f"SELECT * EXCLUDE (rn) REPLACE ({positional(tgt, vals)}) FROM s0"))
    ctes.append(("s2", f"SELECT * REPLACE ({patched(fv.SURFACE_PRE_PATCHES, None)}) FROM s1"))
    ctes.append(("s3", f"SELECT *, {convert('rate', 'unit', fv.SURFACE_RATE_RULES)} AS rate_std FROM s2 WHERE "
                       + " AND ".join(f"paper_name <> {sql_str(p)}" for p in fv.SURFACE_EXCLUDED)))
    ctes.append(("s4", f"SELECT * REPLACE (NULLIF(method_family, 'NA') AS method_family, NULLIF(climate, 'NA') AS climate) "
                       f"FROM s3 WHERE {nonneg('rate_std')}"))
    ctes.append(("s5", f"SELECT * REPLACE ({patched(fv.SURFACE_PATCHES, None)}) FROM s4"))
    ctes.append(("surf", f"SELECT * REPLACE ({species} AS species), {genus} FROM s5"))
    # extension
    not_std = (f"NOT {in_set('unit', fv.BIOMASS_UNITS + fv.SURFACE_UNITS + [fv.VOLUME_UNIT])} AND {not_contains('unit', '%')} "
               f"AND NOT {in_set('unit', fv.NON_STANDARD_EXCLUDED)} AND NOT {in_set('unit', fv.NON_STANDARD_ALREADY_USED)}")
    ctes.append(("e0", f"SELECT * REPLACE (CASE WHEN {in_set('unit', fv.EXTENSION_TO_CANONICAL)} THEN {sql_str(fv.CANONICAL_EXTENSION)} "
                       f"ELSE unit END AS unit) FROM prepared WHERE {not_std}"))
    ctes.append(("e1", f"SELECT * REPLACE (NULLIF(method_family, 'NA') AS method_family, NULLIF(climate, 'NA') AS climate), "
                       f"{convert('rate', 'unit', fv.EXTENSION_RATE_RULES)} AS rate_std FROM e0"))
    ctes.append(("e2", f"SELECT * REPLACE ({patched(fv.EXTENSION_PATCHES, None)}) FROM e1"))
    ctes.append(("ext", f"SELECT * REPLACE ({species} AS species), {genus} FROM e2"))
    # rescue
    ctes.append(("with_na", "SELECT DISTINCT paper_name FROM prepared WHERE method = 'NA'"))
    ctes.append(("used", "SELECT paper_name FROM ext UNION SELECT paper_name FROM biom UNION SELECT paper_name FROM vol "
                         "UNION SELECT paper_name FROM surf"))
    ctes.append(("inc_keys", "SELECT paper_name FROM with_na w WHERE NOT EXISTS "
                             "(SELECT 1 FROM used u WHERE u.paper_name IS NOT DISTINCT FROM w.paper_name)"))
    tgt, vals = fv.RESCUE_POSITIONAL
    ctes.append(("i0", f"SELECT p.*, row_number() OVER (PARTITION BY paper_name ORDER BY {ORDER_SQL}) AS rn FROM prepared p "
                       f"WHERE EXISTS (SELECT 1 FROM inc_keys k WHERE k.paper_name IS NOT DISTINCT FROM p.paper_name) "
                       f"AND {not_contains('unit', '%')} AND temperature <> {sql_lit(fv.RESCUE_TEMPERATURE_EXCLUDED)} "
                       f"AND rate IS NOT NULL"))
    ctes.append(("i1", f"SELECT * EXCLUDE (rn) REPLACE ({positional(tgt, vals)}) FROM i0 "
                       f"WHERE {not_contains('paper_name', fv.RESCUE_STUDY_PATTERN_EXCLUDED)}"))
    ctes.append(("i2", f"SELECT * REPLACE ({patched(fv.RESCUE_PATCHES, None)}) FROM i1"))
    ctes.append(("rescued", f"SELECT * REPLACE ({species} AS species), {genus}, "
                            f"{convert('rate', 'unit', fv.RESCUE_EXTENSION_RULES)} AS rate_ext, "
                            f"{convert('rate', 'unit', fv.RESCUE_SURFACE_RULES)} AS rate_surf, "
                            f"{convert('rate', 'unit', fv.RESCUE_BIOMASS_RULES)} AS rate_biom FROM i2"))
    cols8 = "paper_name, genus, climate, temperature, method_family, rate_std, error, unit"
    cols8r = "paper_name, genus, climate, temperature, method_family, {t} AS rate_std, error, unit"
    ctes.append(("biom_tot", f"SELECT * FROM (SELECT {cols8} FROM biom UNION ALL SELECT {cols8} FROM vol UNION ALL "
                             f"SELECT {cols8r.format(t='rate_biom')} FROM rescued WHERE rate_biom IS NOT NULL) "
                             f"WHERE {nonneg('rate_std')}"))
    ctes.append(("g0", f"SELECT {cols8}, {sql_str(fv.STANDARDIZATION_BIOMASS)} AS standardization FROM biom_tot UNION ALL "
                       f"SELECT {cols8}, {sql_str(fv.STANDARDIZATION_SURFACE)} FROM surf UNION ALL "
                       f"SELECT {cols8r.format(t='rate_surf')}, {sql_str(fv.STANDARDIZATION_SURFACE)} FROM rescued WHERE rate_surf IS NOT NULL UNION ALL "
                       f"SELECT {cols8}, {sql_str(fv.STANDARDIZATION_EXTENSION)} FROM ext UNION ALL "
                       f"SELECT {cols8r.format(t='rate_ext')}, {sql_str(fv.STANDARDIZATION_EXTENSION)} FROM rescued WHERE rate_ext IS NOT NULL"))
    num = f"CASE WHEN regexp_matches(error, {sql_str(NUMBER_PATTERN)}) THEN TRY_CAST(trim(error) AS DOUBLE) END"
    ctes.append(("g1", f"SELECT paper_name, genus, climate, temperature, method_family, rate_std, "
                       f"{convert('(' + num + ')', 'unit', fv.ERROR_RULES)} AS std_error, standardization FROM g0 "
                       f"UNION ALL SELECT * FROM extra"))
    old, new = fv.CLIMATE_RECODE
    g_genus, g_clim = fv.BIOMASS_GENUS_CLIMATE_FIX
    ctes.append(("g2", f"SELECT * REPLACE (CASE WHEN climate = {sql_str(old)} THEN {sql_str(new)} ELSE climate END AS climate, "
                       f"{patched(fv.GROWTH_PATCHES, None)}) FROM g1"))
    ctes.append(("growth", f"SELECT * REPLACE (CASE WHEN standardization = {sql_str(fv.STANDARDIZATION_BIOMASS)} AND "
                           f"genus = {sql_str(g_genus)} THEN {sql_str(g_clim)} ELSE climate END AS climate) FROM g2"))
    ctes.append(("data_cca", f"SELECT * REPLACE (rate_std / 1000 * 365.25 AS rate_std, std_error / 1000 * 365.25 AS std_error) "
                             f"FROM growth WHERE standardization = {sql_str(fv.STANDARDIZATION_SURFACE)}"))
    ctes.append(("reference_rates", "SELECT pubyear, genus, species, conx / 1000 * 365.25 AS conx FROM ("
                           "SELECT * FROM (SELECT DISTINCT * FROM ref_part1) WHERE pubyear IS NOT NULL AND genus IS NOT NULL "
                           "AND species IS NOT NULL AND conx IS NOT NULL UNION ALL SELECT DISTINCT * FROM ref_part2)"))
    return ctes


def review_with(body: str, extra_views: tuple[str, ...] = ("ref_part1", "ref_part2")) -> str:
    v = sql_views()
    ctes = [(n, v[n]) for n in extra_views] + review_ctes()
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in ctes) + "\n" + body
