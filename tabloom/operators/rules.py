"""Constraints on a table: mined, measured, and used to repair rows.

Every predicate is a Column, so all masks of a report or a repair run in one pass over the data.  Derived targets are
given by a function that returns a Column.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.scalars import clip, col, day_difference, hhmm_seconds, to_double
from tabloom.operators.profile import LISTED, Schema
from tabloom.plans.ordering import numbered, spread
from tabloom.session import checkpoint

FILL_MODES = ("fill_missing", "fill_missing_datetime")


@dataclass
class Derived:
    """target is what ``fn()`` makes of the inputs, within a tolerance by kind (numeric, datetime, time, categorical)."""

    target: str
    inputs: list[str]
    fn: Callable[[], Column]
    kind: str = "numeric"
    tolerance: float = 0.0
    target_missing_rate: float | None = None
    #: Whether an undefined expectation (a zero divisor) makes a row out of range.
    infinite: Callable[[], Column] | None = None


@dataclass
class ConditionalBlank:
    """Where the parent is inactive, the children are blank."""

    parent: str
    children: list[str]
    inactive_prefixes: list[str] = field(default_factory=list)
    inactive_values: list[str] = field(default_factory=list)

    def inactive(self) -> Column:
        text = col(self.parent).cast("string")
        found = text.isin(self.inactive_values) if self.inactive_values else F.lit(False)
        for prefix in self.inactive_prefixes:
            found = found | text.startswith(prefix)
        return F.coalesce(found, F.lit(False))


@dataclass
class Constraints:
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)
    allowed: dict[str, list] = field(default_factory=dict)
    derived: list[Derived] = field(default_factory=list)
    blanks: list[ConditionalBlank] = field(default_factory=list)
    mode: str = "overwrite"

    def over(self, columns: Sequence[str]) -> Constraints:
        """The rules that a table with these columns can be held to."""
        there = set(columns)
        return Constraints(
            {c: r for c, r in self.ranges.items() if c in there},
            {c: v for c, v in self.allowed.items() if c in there and v},
            [r for r in self.derived if r.target in there and there.issuperset(r.inputs)],
            [ConditionalBlank(r.parent, kids, r.inactive_prefixes, r.inactive_values) for r in self.blanks if r.parent in there and (kids := [c for c in r.children if c in there])],
            self.mode,
        )


def mine(schema: Schema, mode: str = "overwrite") -> Constraints:
    """Ranges of numeric columns and value lists of categorical ones, from a profile."""
    ranges = {c.name: (c.min_value, c.max_value) for c in schema.columns if c.kind == "numeric" and c.min_value is not None}
    allowed = {c.name: c.allowed_values for c in schema.columns if c.kind in ("categorical", "binary") and c.unique_count <= LISTED}
    return Constraints(ranges, allowed, mode=mode)


def numbers(df: DataFrame) -> frozenset[str]:
    """The columns that hold numbers already and need no parsing."""
    return frozenset(c for c, kind in df.dtypes if kind.startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")))


def number(c: str, typed: frozenset[str] = frozenset()) -> Column:
    return F.nanvl(col(c).cast("double"), F.lit(None).cast("double")) if c in typed else to_double(col(c))


def out_of_range(c: str, low: float, high: float, typed: frozenset[str] = frozenset()) -> Column:
    return F.coalesce(~number(c, typed).between(low, high), F.lit(False))


def not_allowed(c: str, values: Sequence, typed: frozenset[str] = frozenset()) -> Column:
    """Text and numbers compare as they print; a number also as the number that a listed text spells."""
    spelled = [float(v) for v in values if _spells(v)]
    if c in typed:
        member = number(c, typed).isin(spelled)
    else:
        listed = col(c).cast("string").isin([str(v) for v in values])
        member = listed | F.coalesce(to_double(col(c)).isin(spelled), F.lit(False)) if spelled else listed
    return F.coalesce(~member, F.lit(False))


def _spells(v: object) -> bool:
    try:
        return abs(float(str(v))) < float("inf")
    except ValueError:
        return False


def off_derived(rule: Derived, typed: frozenset[str] = frozenset()) -> Column:
    """Whether the target differs from what is expected; a null on either side does not."""
    actual, expected = col(rule.target), rule.fn()
    if rule.kind == "datetime":
        wrong = F.abs(day_difference(actual, expected)) > rule.tolerance
    elif rule.kind == "time":
        wrong = F.abs(hhmm_seconds(actual) - hhmm_seconds(expected)) > rule.tolerance
    elif rule.kind == "categorical":
        wrong = actual != expected
    else:
        wrong = F.abs(number(rule.target, typed) - expected.cast("double")) > rule.tolerance
    return F.coalesce(wrong, F.lit(False))


def rate(mask: Column) -> Column:
    return F.coalesce(F.avg(mask.cast("double")), F.lit(0.0))


def blank_rate(rule: ConditionalBlank) -> Column:
    """The mean over children of the share of rows with an inactive parent where the child is present."""
    shares = [F.coalesce(F.avg(F.when(rule.inactive(), col(c).isNotNull().cast("double"))), F.lit(0.0)) for c in rule.children]
    total = shares[0]
    for s in shares[1:]:
        total = total + s
    return total / float(len(shares))


def rates(constraints: Constraints, columns: Sequence[str], typed: frozenset[str] = frozenset()) -> list[tuple[str, str, Column]]:
    """(kind of rule, name, aggregate) of every rule."""
    c = constraints.over(columns)
    found = [("conditional_blank", f"{r.parent}", blank_rate(r)) for r in c.blanks]
    found += [("range", name, rate(out_of_range(name, *bounds, typed))) for name, bounds in c.ranges.items()]
    found += [("category", name, rate(not_allowed(name, values, typed))) for name, values in c.allowed.items()]
    return found + [("derived", r.target, rate(off_derived(r, typed))) for r in c.derived]


def violations(df: DataFrame, constraints: Constraints) -> DataFrame:
    """(rule, name, rate): all rules in one aggregation."""
    found = rates(constraints, df.columns, numbers(df))
    if not found:
        return df.sparkSession.createDataFrame([], "rule string, name string, rate double")
    one = df.agg(*[a.alias(f"r{i}") for i, (_, _, a) in enumerate(found)])
    cells = [F.struct(F.lit(k).alias("rule"), F.lit(n).alias("name"), F.col(f"r{i}").alias("rate")) for i, (k, n, _) in enumerate(found)]
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def logic_score(df: DataFrame, constraints: Constraints) -> DataFrame:
    """One row: 1 less the mean of all rules' rates, at least 0."""
    return violations(df, constraints).agg(F.greatest(F.lit(0.0), 1.0 - F.coalesce(F.avg("rate"), F.lit(0.0))).alias("logic_score"))


def clip_ranges(df: DataFrame, constraints: Constraints) -> DataFrame:
    """Numbers held in their ranges; what is no number becomes null."""
    typed = numbers(df)
    return df.withColumns({c: clip(number(c, typed), *bounds) for c, bounds in constraints.over(df.columns).ranges.items()})


def normalise_categories(df: DataFrame, constraints: Constraints) -> DataFrame:
    typed = numbers(df)
    return df.withColumns({c: F.when(~not_allowed(c, values, typed), col(c)) for c, values in constraints.over(df.columns).allowed.items()})


def enforce_blanks(df: DataFrame, constraints: Constraints) -> DataFrame:
    """Children of inactive parents blanked, rule by rule: a child blanked by one rule is an active parent to the next."""
    for rule in constraints.over(df.columns).blanks:
        inactive = rule.inactive()
        df = df.withColumns({c: F.when(~inactive, col(c)) for c in rule.children})
    return df


def recompute(df: DataFrame, constraints: Constraints) -> DataFrame:
    """Derived targets overwritten, or only filled in where the mode says so."""
    for rule in constraints.over(df.columns).derived:
        expected = rule.fn()
        fills = constraints.mode == "fill_missing" or (constraints.mode == "fill_missing_datetime" and rule.kind in ("datetime", "time"))
        df = df.withColumn(rule.target, F.coalesce(col(rule.target).cast("string") if rule.kind in ("datetime", "time") else col(rule.target), expected) if fills else expected)
    return df


def invalid(constraints: Constraints, columns: Sequence[str], typed: frozenset[str] = frozenset()) -> Column:
    """Whether a row breaks any range, list or derived rule (dates and times aren't held to it in fill modes)."""
    c = constraints.over(columns)
    masks = [out_of_range(name, *bounds, typed) for name, bounds in c.ranges.items()]
    masks += [not_allowed(name, values, typed) for name, values in c.allowed.items()]
    masks += [off_derived(r, typed) for r in c.derived if not (c.mode in FILL_MODES and r.kind in ("datetime", "time"))]
    masks += [F.coalesce(r.infinite(), F.lit(False)) for r in c.derived if r.infinite and r.target in c.ranges and c.mode == "overwrite"]
    found = F.lit(False)
    for m in masks:
        found = found | m
    return found


def repair(df: DataFrame, constraints: Constraints, order: str | None = None) -> DataFrame:
    """Clip, normalise, blank, recompute, align what is missing, and drop what stays invalid."""
    df = recompute(enforce_blanks(normalise_categories(clip_ranges(df, constraints), constraints), constraints), constraints)
    if order and constraints.mode in FILL_MODES:
        df = align_missingness(df, constraints, order)
    return df.where(~invalid(constraints, df.columns, numbers(df)))


def repair_to_size(df: DataFrame, constraints: Constraints, order: str, sample: Callable[[int, int], DataFrame], rows: int, attempts: int = 3) -> DataFrame:
    """The repaired rows, topped up to ``rows`` with repaired samples in at most ``attempts`` draws."""
    kept = repair(df, constraints, order)
    for attempt in range(attempts):
        n = kept.count()
        if n >= rows:
            break
        more = repair(sample(rows - n, attempt + 1), constraints, order)
        top = kept.agg(F.coalesce(F.max(col(order)), F.lit(-1))).first()[0]
        kept = numbered(kept.unionByName(more.withColumn(order, col(order) + F.lit(top + 1))), order, "__at").where(F.col("__at") <= rows).drop("__at")
    return kept


def _chosen(df: DataFrame, order: str, candidate: Column, count: Column, name: str) -> DataFrame:
    """df with a flag on ``count`` of the candidates, evenly spread in file order."""
    marked = numbered(df.withColumn("__cand", candidate).withColumn("__count", count), order, "__rn", by=["__cand"])
    total = marked.where("__cand").agg(F.count("*").alias("__total"))
    flag = F.col("__cand") & spread(F.col("__count"), F.col("__total"), F.col("__rn") - 1)
    return marked.crossJoin(F.broadcast(total)).withColumn(name, F.coalesce(flag, F.lit(False))).drop("__cand", "__count", "__rn", "__total")


def soft_align(df: DataFrame, real: DataFrame, constraints: Constraints, order: str, strength: float, least_excess: float = 0.05, include: Sequence[str] = (), exclude: Sequence[str] = (), include_children: Sequence[str] = (), exclude_children: Sequence[str] = (), most: int | None = None) -> tuple[DataFrame, list[dict]]:
    """Conditional blanks brought towards the real rate: of the present children of inactive parents an evenly spread part
    is blanked.  Rules run in order, since they share children; each costs one aggregate, and a window where it acts."""
    strength = min(1.0, max(0.0, strength))
    summary: list[dict] = []
    if strength <= 0:
        return df, summary
    for rule in constraints.over([c for c in df.columns if c in real.columns]).blanks:
        if not selected(rule.parent, include, exclude):
            continue
        inactive, kids = rule.inactive(), [c for c in rule.children if selected(c, include_children, exclude_children)]
        if not kids:
            continue
        counts = [F.count_if(inactive).alias("n")] + [F.count_if(inactive & col(c).isNotNull()).alias(f"k{i}") for i, c in enumerate(kids)]
        ours, theirs = df.agg(*counts).first(), real.agg(*counts).first()
        for i, child in enumerate(kids):
            present = ours[f"k{i}"]
            if not ours.n or not present:
                continue
            real_rate = theirs[f"k{i}"] / theirs.n if theirs.n else 0.0
            before = present / ours.n
            excess = before - real_rate
            if excess <= max(0.0, least_excess):
                continue
            target = max(real_rate, before - strength * excess)
            count = present - round(target * ours.n)
            count = count if most is None else min(count, max(most, 0))
            if count <= 0:
                continue
            df = _chosen(df, order, inactive & col(child).isNotNull(), F.lit(count), "__pick")
            df = checkpoint(df.withColumn(child, F.when(~F.col("__pick"), col(child))).drop("__pick"))
            summary.append({"parent": rule.parent, "child": child, "syn_rate_before": before, "real_rate": real_rate, "target_rate": target, "blanked_rows": min(count, present)})
    return df, summary


def selected(name: str, include: Sequence[str], exclude: Sequence[str]) -> bool:
    """Whether a name holds any of the terms to include and none of those to exclude, in any case."""
    text = name.lower()
    terms = [t.strip().lower() for t in include if t.strip()]
    barred = [t.strip().lower() for t in exclude if t.strip()]
    return (not terms or any(t in text for t in terms)) and not any(t in text for t in barred)


def align_missingness(df: DataFrame, constraints: Constraints, order: str) -> DataFrame:
    """Dates and times made from inputs blanked up to the share that is missing in the source, first where an auxiliary
    input is missing, then elsewhere, evenly spread."""
    for rule in constraints.over(df.columns).derived:
        if constraints.mode not in FILL_MODES or rule.target_missing_rate is None or rule.kind not in ("datetime", "time"):
            continue
        here = col(rule.target).isNotNull()
        missing_aux = F.lit(len(rule.inputs) <= 1)
        for c in rule.inputs[1:]:
            missing_aux = missing_aux | col(c).isNull()
        got = df.agg(F.count("*").alias("n"), F.count_if(~here).alias("m"), F.count_if(here & missing_aux).alias("first")).first()
        deficit = round(rule.target_missing_rate * got.n) - got.m
        if deficit <= 0:
            continue
        df = _chosen(df, order, here & missing_aux, F.lit(min(deficit, got.first)), "__a")
        df = _chosen(df, order, here & ~F.col("__a"), F.lit(deficit - min(deficit, got.first)), "__b")
        df = df.withColumn(rule.target, F.when(~(F.col("__a") | F.col("__b")), col(rule.target))).drop("__a", "__b")
        df = checkpoint(df)
    return df


