"""The normal distribution and seeded uniforms as Column expressions.

The quantile is Wichura's AS241 (PPND16), the distribution function Hart's rational form as given by West (2005); both
are accurate to about 1e-15.  Uniforms are the first 52 bits of an MD5 of "seed|row|name": any engine can repeat
them, and a row's draws depend on neither its partition nor its order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The published coefficients, from the highest power down.
A = (2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080e0)
B = (5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0)
C = (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e0, 3.64784832476320460504e0, 5.76949722146069140550e0, 4.63033784615654529590e0, 1.42343711074968357734e0)
D = (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e0, 2.05319162663775882187e0, 1.0)
E = (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e0, 5.46378491116411436990e0, 6.65790464350110377720e0)
G = (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0)
P = (3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
Q = (8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
TURN, TAIL = 7.07106781186547, 2.506628274631
EPSILON = 1e-6
UNIT = 1 << 52


def horner(x: Column, coefficients: Sequence[float]) -> Column:
    total = F.lit(coefficients[0])
    for c in coefficients[1:]:
        total = total * x + F.lit(c)
    return total


def horner_sql(x: str, coefficients: Sequence[float]) -> str:
    total = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        total = f"({total} * {x} + {c!r}::DOUBLE)"
    return total


def quantile(p: Column) -> Column:
    """The standard normal quantile of a probability strictly between 0 and 1."""
    q = p - 0.5
    r = F.lit(0.180625) - q * q
    middle = q * horner(r, A) / horner(r, B)
    t = F.sqrt(-F.ln(F.least(p, F.lit(1.0) - p)))
    near, far = t - 1.6, t - 5.0
    outer = F.when(t <= 5.0, horner(near, C) / horner(near, D)).otherwise(horner(far, E) / horner(far, G))
    return F.when(F.abs(q) <= 0.425, middle).when(q < 0, -outer).otherwise(outer)


def quantile_sql(p: str) -> str:
    """The same in SQL; p is a column name."""
    q, r = f"({p} - 0.5::DOUBLE)", f"(0.180625::DOUBLE - ({p} - 0.5::DOUBLE) * ({p} - 0.5::DOUBLE))"
    t = f"sqrt(-ln(least({p}, 1.0::DOUBLE - {p})))"
    near, far = f"({t} - 1.6::DOUBLE)", f"({t} - 5.0::DOUBLE)"
    outer = f"(CASE WHEN {t} <= 5.0 THEN {horner_sql(near, C)} / {horner_sql(near, D)} ELSE {horner_sql(far, E)} / {horner_sql(far, G)} END)"
    return f"(CASE WHEN abs({q}) <= 0.425 THEN {q} * {horner_sql(r, A)} / {horner_sql(r, B)} WHEN {q} < 0 THEN -{outer} ELSE {outer} END)"


def distribution(x: Column) -> Column:
    """The standard normal distribution function."""
    a = F.abs(x)
    e = F.exp(-a * a / 2.0)
    fraction = a + F.lit(0.65)
    for k in (4.0, 3.0, 2.0, 1.0):
        fraction = a + F.lit(k) / fraction
    upper = F.when(a > 37.0, F.lit(0.0)).when(a < TURN, e * horner(a, P) / horner(a, Q)).otherwise(e / fraction / TAIL)
    return F.when(x > 0, F.lit(1.0) - upper).otherwise(upper)


def distribution_sql(x: str) -> str:
    a = f"abs({x})"
    e = f"exp(-{a} * {a} / 2.0::DOUBLE)"
    fraction = f"({a} + 0.65::DOUBLE)"
    for k in (4, 3, 2, 1):
        fraction = f"({a} + {k}.0::DOUBLE / {fraction})"
    upper = f"(CASE WHEN {a} > 37.0 THEN 0.0::DOUBLE WHEN {a} < {TURN!r} THEN {e} * {horner_sql(a, P)} / {horner_sql(a, Q)} ELSE {e} / {fraction} / {TAIL!r}::DOUBLE END)"
    return f"(CASE WHEN {x} > 0 THEN 1.0::DOUBLE - {upper} ELSE {upper} END)"


def uniform(seed: int, row: Column, name: str) -> Column:
    """A number in [0, 1) that the seed, the row's number and a name decide."""
    key = F.concat_ws("|", F.lit(str(seed)), row.cast("string"), F.lit(name))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(UNIT))


def uniform_sql(seed: int, row: str, name: str) -> str:
    return f"(('0x' || substr(md5('{seed}|' || CAST({row} AS VARCHAR) || '|{name}'), 1, 13))::BIGINT / {float(UNIT)}::DOUBLE)"


def inside(p: Column) -> Column:
    """A probability held EPSILON away from 0 and 1."""
    return F.when(p < EPSILON, F.lit(EPSILON)).when(p > 1 - EPSILON, F.lit(1 - EPSILON)).otherwise(p)


def inside_sql(p: str) -> str:
    return f"least(greatest({p}, {EPSILON!r}::DOUBLE), {1 - EPSILON!r}::DOUBLE)"


def quantiles(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with the quantile of each column (new name -> column of probabilities).  Powers are taken in steps, each from
    columns, so no argument is written out many times over."""
    at = {name: F.col(f"`{c}`") - 0.5 for name, c in columns.items()}
    tail = {f"{name}__t": F.sqrt(-F.ln(F.least(F.col(f"`{c}`"), F.lit(1.0) - F.col(f"`{c}`")))) for name, c in columns.items()}
    df = df.withColumns({f"{name}__q": q for name, q in at.items()} | tail)
    out = {}
    for name in columns:
        q, t = F.col(f"`{name}__q`"), F.col(f"`{name}__t`")
        r = F.lit(0.180625) - q * q
        outer = F.when(t <= 5.0, horner(t - 1.6, C) / horner(t - 1.6, D)).otherwise(horner(t - 5.0, E) / horner(t - 5.0, G))
        out[name] = F.when(F.abs(q) <= 0.425, q * horner(r, A) / horner(r, B)).when(q < 0, -outer).otherwise(outer)
    return df.withColumns(out).drop(*[f"{name}__{x}" for name in columns for x in "qt"])


def drawn(df: DataFrame, names: dict[str, str], seed: int, row: str) -> DataFrame:
    """df with a seeded standard normal for each new column (new name -> name that decides the draw)."""
    df = df.withColumns({f"{new}__u": uniform(seed, F.col(f"`{row}`"), name) for new, name in names.items()})
    df = df.withColumns({f"{new}__u": inside(F.col(f"`{new}__u`")) for new in names})
    return quantiles(df, {new: f"{new}__u" for new in names}).drop(*[f"{new}__u" for new in names])
