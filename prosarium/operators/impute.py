"""Missing values from similar records: chained equations with distributed fits."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ranking import null_safe_join, salted_join

RIDGE = 1e-6
PRIOR = 4.0  # records that the overall mean weighs in a group's mean


@dataclass(frozen=True)
class Numeric:
    """A field with the open range of its usable values; modelled as a logarithm."""

    name: str
    above: float
    below: float

    def usable(self) -> Column:
        x = F.nanvl(F.col(self.name).cast("double"), F.lit(None).cast("double"))
        return F.when((x > self.above) & (x < self.below), x)


@dataclass(frozen=True)
class Categorical:
    """A field whose usable values match a pattern."""

    name: str
    pattern: str

    def usable(self) -> Column:
        return F.when(F.col(self.name).rlike(self.pattern), F.col(self.name))


def _normal(seed: int, *on: Column) -> Column:
    """Standard normal deviate that only depends on the row: Box-Muller over two hashes."""
    u = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), *on), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return F.sqrt(-2 * F.log(u(1))) * F.cos(2 * np.pi * u(2))


def chained_impute(
    df: DataFrame, key: str, group: str, numeric: list[Numeric], categorical: list[Categorical] = (), predictors: dict[str, Column] | None = None, where: Column | None = None, tolerance: float = 1e-3, most_rounds: int = 30, seed: int = 7
) -> DataFrame:
    """One row per (record, field) to be filled: key, field_name, number, category.

    Every record of df counts, repeated deliveries each by itself (`key` is unique). `where` limits the numeric fields to
    records that should have them. A value is missing if it is null, NaN or not usable by the
    field's rule. The chain holds the numeric fields, the predictors, and the categorical fields: in each round
    each incomplete number is regressed on all others as filled so far, on the means of its group and
    on the mean of its class, and each missing class is drawn from the classes of the record's group, by their counts times
    the Gaussian likelihood of the numbers as filled so far. A missing number
    becomes the prediction plus a normal deviate of the residual size, drawn from a hash of the
    record, so residual variation is kept, results repeat, and the rounds converge: they end when no coefficient
    changes by more than `tolerance`, or after `most_rounds`. In a group without any usable class the most frequent of all stands in.

    Records without a missing value enter all fits by one matrix of sums of products, (fields + predictors
    + means + 1)^2 numbers that are computed once; rounds touch only records with a missing value, one
    aggregation for the fits of all fields and one draw. Joins with means of groups and classes are salted.

    If a field has no usable value at all, numbers stay null and so do categories, and no row is
    given for it. Null groups form a group. An empty table gives no rows.
    """
    predictors = predictors or {}
    there = where if where is not None else F.lit(True)
    y, x, c = [f"y{i}" for i in range(len(numeric))], [f"x{i}" for i in range(len(predictors))], [f"c{i}" for i in range(len(categorical))]
    slim = df.select(
        F.col(key).alias("id"), F.col(group).alias("g"), there.alias("counts"),
        *[F.when(there, F.log(f.usable())).alias(n) for f, n in zip(numeric, y)],
        *[F.when(there, F.nanvl(p.cast("double"), F.lit(None).cast("double"))).alias(n) for p, n in zip(predictors.values(), x)],
        *[f.usable().alias(n) for f, n in zip(categorical, c)],
    )
    overall = slim.agg(F.count(F.lit(1)).alias("rows"), *[F.avg(n).alias(n) for n in [*y, *x]], *[F.count(n).alias(n) for n in c], *[F.expr(f"count_if(counts and {n} is null)").alias(f"no_{n}") for n in [*y, *x]]).first()
    y, x, c = [n for n in y if overall[n] is not None], [n for n in x if overall[n] is not None], [n for n in c if overall[n]]
    targets = [*y, *x]
    gappy = [n for n in targets if overall[f"no_{n}"]]
    if not y and not c:
        return _long(slim.limit(0), [], [], numeric, categorical)

    shrunk = lambda n, to: (F.coalesce(F.sum(n), F.lit(0.0)) + PRIOR * to) / (F.count(n) + PRIOR)
    base = slim
    means = [f"m_{n}" for n in y]
    if y:
        base = salted_join(base, slim.groupBy("g").agg(*[shrunk(n, overall[n]).alias(f"m_{n}") for n in y]), "g", F.col("id"))
    of_class = {n: [f"{n}_{o}" for o in y] for n in c}
    by_class = {n: slim.where(F.col(n).isNotNull()).groupBy(n).agg(*[shrunk(o, overall[o]).alias(k) for o, k in zip(y, of_class[n])]) for n in c}
    for n in c if y else []:
        base = salted_join(base, by_class[n], n, F.col("id"))
    base = cut_lineage(base)

    # Records that count, with all values: their products never change.
    class_means = [k for n in c for k in of_class[n]]
    terms = [*targets, *means, *class_means]
    full = F.col("counts")
    for n in [*targets, *c]:
        full = full & F.col(n).isNotNull()
    lack = F.lit(False)
    for n in c:
        lack = lack | F.col(n).isNull()
    for n in targets:
        lack = lack | (F.col("counts") & F.col(n).isNull())
    fixed = _gram(base.where(full).agg(*_products(terms)).first(), len(terms) + 1) if y else None

    classes = {n: cut_lineage(_class_table(base, by_class[n] if y else None, n, y)) for n in c}
    most = {n: _most_frequent(classes[n]) for n in c}
    now = base.where(lack)
    for n in targets:
        start = F.coalesce(F.col(f"m_{n}") if n in y else F.lit(None), F.lit(float(overall[n])))
        now = now.withColumn(f"f_{n}", F.when(F.col("counts"), F.coalesce(F.col(n), start)))
    for n in c:
        now = _draw(now, n, classes[n], [f"f_{o}" for o in y], of_class[n] if y else [], most[n], seed)
    now = cut_lineage(now)

    before: np.ndarray | None = None
    for _ in range(most_rounds if y else 0):
        vary = [f"f_{n}" for n in targets] + means + [f"d_{n}" for n in class_means]
        k = len(vary) + 1
        each = k * (k + 1) // 2
        sums = now.where("counts").agg(*[p for n in gappy for p in _products(vary, f"{n} is not null")]).first() if gappy else ()
        fits = [_solve(fixed + _gram(sums[i * each : (i + 1) * each], k), 1 + targets.index(n)) for i, n in enumerate(gappy)]
        filled = {}
        for n, (beta, sigma) in zip(gappy, fits):
            guess = F.expr(" + ".join([f"{float(beta[0])!r}D", *(f"{float(w)!r}D * {t}" for t, w in zip(vary, beta[1:]))]))
            filled[f"f_{n}"] = F.when(F.col("counts"), F.coalesce(F.col(n), guess + _normal(seed, F.col("id"), F.lit(n)) * sigma))
        now = now.withColumns(filled)
        for n in c:
            now = _draw(now.drop(f"d_{n}", *[f"d_{m}" for m in of_class[n]]), n, classes[n], [f"f_{o}" for o in y], of_class[n], most[n], seed)
        now = cut_lineage(now)
        after = np.concatenate([np.zeros(1), *(beta for beta, _ in fits)])
        if before is not None and np.max(np.abs(after - before)) < tolerance:
            break
        before = after
    return _long(now, y, c, numeric, categorical)


def _products(terms: list[str], over: str = "true") -> list[Column]:
    """Sums of products of 1 and the terms, the upper triangle row by row."""
    v = ["1D", *terms]
    return [F.expr(f"coalesce(sum(if({over}, {v[i]} * {v[j]}, null)), 0D)") for i in range(len(v)) for j in range(i, len(v))]


def _gram(flat: tuple, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = list(flat)
    return out + np.triu(out, 1).T


def _solve(gram: np.ndarray, target: int) -> tuple[np.ndarray, float]:
    """Ridge least squares of one column on the others: coefficients (0 for itself) and residual size."""
    others = [i for i in range(len(gram)) if i != target]
    n = gram[0, 0]
    xx, xy, yy = gram[np.ix_(others, others)], gram[others, target], gram[target, target]
    beta = np.linalg.lstsq(xx + RIDGE * max(n, 1) * np.eye(len(others)), xy, rcond=None)[0]
    rest = max(0.0, float(yy - 2 * beta @ xy + beta @ xx @ beta))
    whole = np.zeros(len(gram))
    whole[others] = np.round(beta, 9)
    return whole, round(float(np.sqrt(rest / max(n - len(others), 1))), 9)


def _class_table(base: DataFrame, effects: DataFrame | None, n: str, y: list[str]) -> DataFrame:
    """Classes of each group: g, class, k, means and deviations of the numbers as given, and the class's own means.
    Classes of a group are few (a voice has one or two names), but nothing relies on it."""
    moments = [m for f in y for m in (F.avg(f).alias(f"a_{f}"), F.coalesce(F.stddev_pop(f), F.lit(0.0)).alias(f"s_{f}"))]
    table = base.where(F.col(n).isNotNull()).groupBy("g", n).agg(F.count(F.lit(1)).alias("k"), *moments)
    return (table.join(effects, n) if effects is not None else table).withColumnRenamed(n, "class")


def _most_frequent(classes: DataFrame) -> tuple:
    sizes = classes.groupBy("class").agg(F.sum("k").alias("k"), *[F.first(m).alias(m) for m in classes.columns if m not in ("g", "class", "k")])
    return sizes.orderBy(F.desc("k"), "class").limit(1).first()


def _draw(now: DataFrame, n: str, classes: DataFrame, filled: list[str], effects: list[str], most: tuple, seed: int, salts: int = 8) -> DataFrame:
    """Adds d_<n>, the class, drawn for the missing ones from their group's classes, and the class's means."""
    known = now.where(F.col(n).isNotNull()).select("*", F.col(n).alias(f"d_{n}"), *[F.col(e).alias(f"d_{e}") for e in effects])
    missing = now.where(F.col(n).isNull()).withColumn("__salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    score = F.log(F.col("k").cast("double"))
    for f in filled:
        s, mean = F.greatest(F.col(f"s_{f[2:]}"), F.lit(0.02)), F.col(f"a_{f[2:]}")
        score = score - F.coalesce(F.log(s) + F.pow((F.col(f) - mean) / s, 2) / 2, F.lit(0.0))
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.col("class")), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    small = classes.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select("g", "__salt", "class", "k", *[m for f in filled for m in (f"a_{f[2:]}", f"s_{f[2:]}")], *[F.col(e).alias(f"__{e}") for e in effects])
    pairs = null_safe_join(missing, small, ["g", "__salt"], "left")
    best = F.max_by(F.struct("class", *[f"__{e}" for e in effects]), score - F.log(-F.log(u)))
    keep = [m for m in now.columns if m != "id"]
    drawn = pairs.groupBy("id").agg(*[F.first(m).alias(m) for m in keep], best.alias("__best"))
    stand_in = lambda e: F.lit(most[e])
    drawn = drawn.select(*now.columns, F.coalesce(F.col("__best.class"), stand_in("class")).alias(f"d_{n}"), *[F.coalesce(F.col(f"__best.__{e}"), stand_in(e)).alias(f"d_{e}") for e in effects])
    return known.unionByName(drawn)


def _long(now: DataFrame, live: list[str], c: list[str], numeric: list[Numeric], categorical: list[Categorical]) -> DataFrame:
    null = {"n": F.lit(None).cast("double"), "c": F.lit(None).cast("string")}
    parts = [F.struct(F.lit(f.name).alias("field_name"), F.when(F.col(f"y{i}").isNull() & F.col("counts"), F.exp(F.col(f"f_y{i}"))).alias("number"), null["c"].alias("category")) for i, f in enumerate(numeric) if f"y{i}" in live]
    parts += [F.struct(F.lit(f.name).alias("field_name"), null["n"].alias("number"), F.when(F.col(f"c{i}").isNull(), F.col(f"d_c{i}")).alias("category")) for i, f in enumerate(categorical) if f"c{i}" in c]
    if not parts:
        return now.select("id", F.lit("").alias("field_name"), null["n"].alias("number"), null["c"].alias("category"))
    return now.select("id", F.explode(F.array(*parts)).alias("v")).select("id", "v.*").where(F.col("number").isNotNull() | F.col("category").isNotNull())
