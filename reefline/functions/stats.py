"""Statistical Column expressions with no Spark built-in.

``qnorm`` is the inverse standard-normal CDF by Wichura's published algorithm
AS241 (Applied Statistics 37(3), 1988): three rational approximations,
accurate to about 1e-16 - the same algorithm R and Python's ``statistics`` use.
It is a plain CASE over polynomials, so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FIXED VALUES: AS241 coefficients, highest degree first.
_A = [2.5090809287301226727e+3, 3.3430575583588128105e+4, 6.7265770927008700853e+4, 4.5921953931549871457e+4,
      1.3731693765509461125e+4, 1.9715909503065514427e+3, 1.3314166789178437745e+2, 3.3871328727963666080e+0]
_B = [5.2264952788528545610e+3, 2.8729085735721942674e+4, 3.9307895800092710610e+4, 2.1213794301586595867e+4,
      5.3941960214247511077e+3, 6.8718700749205790830e+2, 4.2313330701600911252e+1, 1.0]
_C = [7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e+0,
      3.64784832476320460504e+0, 5.76949722146069140550e+0, 4.63033784615654529590e+0, 1.42343711074968357734e+0]
_D = [1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1,
      6.89767334985100004550e-1, 1.67638483018380384940e+0, 2.05319162663775882187e+0, 1.0]
_E = [2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2,
      2.96560571828504891230e-1, 1.78482653991729133580e+0, 5.46378491116411436990e+0, 6.65790464350110377720e+0]
_F = [2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4,
      1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0]


def _horner(coefs, x: Column) -> Column:
    acc = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def with_qnorm(df, p, out: str):
    """Add ``out = qnorm(p)`` in staged projections.

    ``q`` and the tail variable ``r`` each feed a dozen polynomial terms; as
    separate columns they are computed once per row (Spark does not re-inline a
    non-trivial expression that is referenced several times) instead of
    growing one expression tree dozens of copies deep.
    """
    p = F.col(p) if isinstance(p, str) else p
    df = df.withColumn("__p", p)
    df = df.withColumn("__q", F.col("__p") - F.lit(0.5))
    df = df.withColumns({
        "__r1": F.lit(0.180625) - F.col("__q") * F.col("__q"),
        "__rt": F.sqrt(-F.log(F.when(F.col("__q") <= 0, F.col("__p")).otherwise(F.lit(1.0) - F.col("__p"))))})
    df = df.withColumns({"__rm": F.col("__rt") - 1.6, "__rf": F.col("__rt") - 5.0})
    q, r1, rt, rm, rf = (F.col(c) for c in ("__q", "__r1", "__rt", "__rm", "__rf"))
    central = q * _horner(_A, r1) / _horner(_B, r1)
    tail = F.when(rt <= 5.0, _horner(_C, rm) / _horner(_D, rm)).otherwise(_horner(_E, rf) / _horner(_F, rf))
    res = F.when(F.abs(q) <= 0.425, central).when(q < 0, -tail).otherwise(tail)
    return df.withColumn(out, res).drop("__p", "__q", "__r1", "__rt", "__rm", "__rf")


def qnorm(p) -> Column:
    """Inverse standard-normal CDF (NULL outside (0, 1) is not special-cased: p in [0,1])."""
    p = F.col(p) if isinstance(p, str) else p
    q = p - F.lit(0.5)
    r1 = F.lit(0.180625) - q * q
    central = q * _horner(_A, r1) / _horner(_B, r1)
    r = F.sqrt(-F.log(F.when(q <= 0, p).otherwise(F.lit(1.0) - p)))
    mid = _horner(_C, r - 1.6) / _horner(_D, r - 1.6)
    far = _horner(_E, r - 5.0) / _horner(_F, r - 5.0)
    tail = F.when(r <= 5.0, mid).otherwise(far)
    tail = F.when(q < 0, -tail).otherwise(tail)
    return F.when(F.abs(q) <= 0.425, central).otherwise(tail)


def qnorm_sql(p: str) -> str:
    """The same expression as DuckDB SQL text."""
    def horner(coefs, x):
        acc = repr(coefs[0])
        for c in coefs[1:]:
            acc = f"({acc}) * ({x}) + {c!r}"
        return acc
    q = f"(({p}) - 0.5)"
    r1 = f"(0.180625 - {q} * {q})"
    r = f"sqrt(-ln(CASE WHEN {q} <= 0 THEN ({p}) ELSE 1.0 - ({p}) END))"
    central = f"{q} * ({horner(_A, r1)}) / ({horner(_B, r1)})"
    mid = f"({horner(_C, f'{r} - 1.6')}) / ({horner(_D, f'{r} - 1.6')})"
    far = f"({horner(_E, f'{r} - 5.0')}) / ({horner(_F, f'{r} - 5.0')})"
    tail = f"(CASE WHEN {r} <= 5.0 THEN {mid} ELSE {far} END)"
    return f"(CASE WHEN abs({q}) <= 0.425 THEN {central} WHEN {q} < 0 THEN -{tail} ELSE {tail} END)"
