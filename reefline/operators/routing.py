"""One-pass routing of rows to branches with their own rules (ANA-1 .. ANA-3, CLN-9).

A branch says which units it takes, how it converts and corrects rows and which
of them it keeps.  ``routed`` compiles all branches into two literal maps: unit ->
(branch, canonical unit, factor, ...) and (branch, study) -> corrections.  One
projection looks a row up in both, so a table is read once however many branches
there are, nothing is shuffled, and streaming DataFrames are fine.
``to_targets`` sends a row to every target that it has a value for, by
exploding an array of structs instead of one filtered read per target.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reefline.functions.predicates import nonnegative
from reefline.functions.text import binomial, genus_of, missing_if

Patches = Sequence[tuple[str, object, Sequence[str]]]


@dataclass(frozen=True)
class Branch:
    """Rules of one branch, in the order in which they apply.

    ``units``: the spellings that the branch takes; a branch without them takes what no
    other branch lists and ``takes`` allows.  ``keeps``: the rows it goes on with.
    ``spellings`` fold into ``unit``.  ``early`` are keyed patches before and ``patches``
    keyed patches after conversion by ``rules``; ``rejects`` drops rows by a part of their
    unit.  ``divided``: keys whose rate is divided by a number.  ``excluded``: keys that are
    dropped (rows without a key too).  ``nonnegative`` drops other rates and missing ones.
    ``family`` overrides the method family; without it the text of missing values
    becomes NULL in family and climate."""
    name: str
    rules: Sequence[tuple[str, float]]
    units: Sequence[str] = ()
    takes: Callable[[], Column] | None = None
    keeps: Callable[[], Column] | None = None
    spellings: Sequence[str] = ()
    unit: str | None = None
    early: Patches = ()
    rejects: str | None = None
    divided: tuple[Sequence[str], float] | None = None
    excluded: Sequence[str] = ()
    nonnegative: bool = False
    family: str | None = None
    patches: Patches = ()

    def unit_rule(self, spelling: str | None) -> dict[str, object]:
        """What the branch does with rows of that unit; ``None`` stands for any unit that is not listed."""
        canonical = self.unit if spelling in self.spellings else spelling
        factor = next((float(f) for u, f in self.rules if u == canonical), None)
        return {"branch": self.name, "unit": canonical, "factor": factor, "rejected": bool(self.rejects and canonical and self.rejects in canonical),
                "open": not self.units, "keyed": bool(self.excluded), "nonnegative": self.nonnegative, "family": self.family}

    def studies(self) -> dict[str, dict[str, object]]:
        """Corrections by key; the last patch of a key and column wins."""
        out: dict[str, dict[str, object]] = {}
        for column, value, keys in [*self.early, *self.patches]:
            for k in keys:
                out.setdefault(k, {})[column] = value
        for k in self.excluded:
            out.setdefault(k, {})["excluded"] = True
        for k in self.divided[0] if self.divided else ():
            out.setdefault(k, {})["divisor"] = float(self.divided[1])
        return out


UNIT_RULE = "struct<branch:string,unit:string,factor:double,rejected:boolean,open:boolean,keyed:boolean,nonnegative:boolean,family:string>"
STUDY_RULE = "struct<method:string,method_family:string,climate:string,species:string,divisor:double,excluded:boolean>"


def _literal(value: object, kind: str) -> Column:
    """A nested constant as one expression; the optimizer evaluates it once, when it plans."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def apart(value: Column) -> Column:
    """``value``, evaluated outside the fused stage, as lambdas are.

    A stage is one method, and the JVM never compiles a method of more than 8,000 bytes.  Scan, joins and
    rules together exceed that, and every row would be interpreted; this ends the stage before the rules."""
    return F.element_at(F.transform(F.array(F.lit(0)), lambda _: value), 1)


def _unit_rules(branches: Sequence[Branch], unit: str) -> Column:
    """The rule for the row's unit: that of the first branch that lists it, else that of the open branch, else NULL."""
    listed: dict[str, dict] = {}
    other = None
    for b in branches:
        for u in b.units or [*b.spellings, *[r for r, _ in b.rules]]:
            listed.setdefault(u, b.unit_rule(u))
        if not b.units:
            other = b.unit_rule(None)
    found = F.try_element_at(_literal(listed, f"map<string,{UNIT_RULE}>"), F.col(unit))
    return apart(found if other is None else F.coalesce(found, _literal(other, UNIT_RULE)))


def _study_rules(branches: Sequence[Branch], key: str) -> Column:
    """Corrections for the row's branch (``_u.branch``) and key, NULL where there are none."""
    by_branch = {b.name: b.studies() for b in branches}
    of_branch = F.try_element_at(_literal(by_branch, f"map<string,map<string,{STUDY_RULE}>>"), F.col("_u.branch"))
    return F.try_element_at(of_branch, F.col(key))


def _allowed(branches: Sequence[Branch]) -> Column:
    """Whether the open branch may take the row; true for rows of other branches."""
    for b in branches:
        if not b.units and b.takes is not None:
            return ~F.col("_u.open") | b.takes()
    return F.lit(True)


def branch_name(df: DataFrame, branches: Sequence[Branch], out: str, other: str, unit: str = "unit") -> DataFrame:
    """``df`` with ``out``: the branch that the row's unit sends it to, else ``other``."""
    found = df.withColumn("_u", _unit_rules(branches, unit))
    return found.withColumn(out, F.when(F.coalesce(_allowed(branches), F.lit(False)), F.coalesce("_u.branch", F.lit(other))).otherwise(F.lit(other))).drop("_u")


def routed(df: DataFrame, branches: Sequence[Branch], out: str = "branch", spare: str = "none", key: str = "paper_name", rate: str = "rate",
           result: str = "rate_std", unit: str = "unit", species: str = "species", genus: str = "genus", method: str = "method",
           family: str = "method_family", climate: str = "climate", unless: Column | None = None) -> DataFrame:
    """``df`` with ``out``, ``result`` and ``genus``: rows that a branch keeps carry its name, converted rate and
    corrected columns; all others carry ``spare``, a NULL rate and genus, and their columns as they were.
    Rows where ``unless`` holds are kept by no branch."""
    staged = df.withColumn("_u", _unit_rules(branches, unit)).withColumn("_p", _study_rules(branches, key))
    raw = F.col(rate) * F.col("_u.factor")
    staged = staged.withColumn("_rate", F.when(F.col("_p.divisor").isNotNull(), raw / F.col("_p.divisor")).otherwise(raw))
    keeps = F.col("_u").isNotNull() & ~F.col("_u.rejected") & _allowed(branches)
    keeps = keeps & (~F.col("_u.keyed") | (F.col(key).isNotNull() & ~F.coalesce(F.col("_p.excluded"), F.lit(False))))
    keeps = keeps & (~F.col("_u.nonnegative") | nonnegative("_rate"))
    for b in branches:
        if b.keeps is not None:
            keeps = keeps & ((F.col("_u.branch") != b.name) | b.keeps())
    if unless is not None:
        keeps = keeps & ~unless
    staged = staged.withColumn("_kept", F.coalesce(keeps, F.lit(False)))

    def when_kept(value: Column, column: str) -> Column:
        return F.when(F.col("_kept"), value).otherwise(F.col(column)).alias(column)

    own = F.col("_u.family")
    named = F.coalesce("_p.species", F.col(species))
    changed = {
        unit: when_kept(F.coalesce("_u.unit", F.col(unit)), unit),
        species: when_kept(binomial(named), species),
        method: when_kept(F.coalesce("_p.method", F.col(method)), method),
        family: when_kept(F.coalesce("_p.method_family", own, missing_if(family)), family),
        climate: when_kept(F.coalesce(F.col("_p.climate"), F.when(own.isNull(), missing_if(climate)).otherwise(F.col(climate))), climate),
    }
    row = F.struct(
        *[changed.get(c, F.col(c)) for c in df.columns if c not in (out, result, genus)],
        F.when(F.col("_kept"), genus_of(named)).alias(genus), F.when(F.col("_kept"), F.col("_rate")).alias(result),
        F.when(F.col("_kept"), F.col("_u.branch")).otherwise(F.lit(spare)).alias(out))
    # emitted as an array of rows: a later filter on the branch reads it and does not evaluate the rules again
    return staged.select(F.inline(F.array(row)))


def to_targets(df: DataFrame, targets: Mapping[str, str], out: str, result: str) -> DataFrame:
    """CLN-9: one row for each column of ``targets`` (column -> label) that holds a value, as ``result`` labelled in ``out``.

    The value columns go; a row without a value in any of them goes too."""
    options = F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(label).alias(out), F.col(c).alias(result))) for c, label in targets.items()])
    rest = [c for c in df.columns if c not in targets]
    return df.select(*rest, F.explode(F.array_compact(options)).alias("_t")).select(*rest, f"_t.{out}", f"_t.{result}")
