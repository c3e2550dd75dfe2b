"""Errors of predicted against gold intervals on several levels (G19, G20 with J9, J10 and J15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .align import paired_intervals
from .intervals import overlap_join


def interval_errors(gold: DataFrame, pred: DataFrame, keys: list[str], order: str, begin: str, end: str, text: str, width: float = 15.0, sentences: DataFrame | None = None) -> DataFrame:
    """One row per part of each level: keys, level, part, gold, matched, arr, and mae_ and rmse_ of start, end and duration.

    Levels are 'entire' (part 0), 'window' (windows of `width` seconds) and, with `sentences` (keys, s_no, s_start, s_end),
    'sentence'. An interval belongs to every part it overlaps; parts without gold intervals have no row. In each part
    gold and predicted intervals are paired anew by their texts (J15). arr is the share of gold intervals with a
    partner; errors are null where none has one. Intervals with a null bound are left out."""
    parts = [_by_level(side, keys, begin, end, width, sentences) for side in (gold, pred)]
    pairs = paired_intervals(*parts, [*keys, "level", "part"], order, begin, end, text)
    e = F.col("errors")
    mean = lambda f: F.when(F.size(e) > 0, F.aggregate(e, F.lit(0.0), lambda s, x: s + f(x)) / F.size(e))
    named = [(k, w) for w in ("start", "end", "dur") for k in ("mae", "rmse")]
    cols = [(mean(lambda x, w=w: x[w]) if k == "mae" else F.sqrt(mean(lambda x, w=w: x[w] * x[w]))).alias(f"{k}_{w}") for k, w in named]
    return pairs.select(*keys, "level", "part", "gold", F.size(e).alias("matched"), (F.size(e) / F.col("gold")).alias("arr"), *cols)


def _by_level(side: DataFrame, keys: list[str], begin: str, end: str, width: float, sentences: DataFrame | None) -> DataFrame:
    known = side.where(F.col(begin).isNotNull() & F.col(end).isNotNull())
    # The last window that an interval overlaps begins before its end.
    last = F.ceil(F.col(end) / width) - 1
    windows = F.when(F.col(end) > F.col(begin), F.sequence(F.floor(F.col(begin) / width), F.greatest(last, F.floor(F.col(begin) / width))))
    out = known.select("*", F.lit("entire").alias("level"), F.lit(0).cast("bigint").alias("part"))
    out = out.unionByName(known.where(F.col(end) > F.col(begin)).select("*", F.lit("window").alias("level"), F.explode(windows.cast("array<bigint>")).alias("part")))
    if sentences is not None:
        inside = overlap_join(known, sentences, keys, begin, end, "s_start", "s_end", bucket=width)
        out = out.unionByName(inside.select(*known.columns, F.lit("sentence").alias("level"), F.col("s_no").cast("bigint").alias("part")))
    return out


def level_summary(errors: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, level, parts, mean and standard deviation of arr, means of the mae over the parts that have one."""
    return errors.groupBy(*keys, "level").agg(F.count(F.lit(1)).alias("parts"), F.avg("arr").alias("mean_arr"), F.stddev_pop("arr").alias("std_arr"), *[F.avg(f"mae_{w}").alias(f"mean_mae_{w}") for w in ("start", "end", "dur")])


def word_errors(gold: DataFrame, pred: DataFrame, keys: list[str], order: str, begin: str, end: str, text: str) -> DataFrame:
    """G20, word level: keys, words, and mean, median and greatest absolute error of start, end and duration over all pairs."""
    known = lambda df: df.where(F.col(begin).isNotNull() & F.col(end).isNotNull())
    pairs = paired_intervals(known(gold), known(pred), keys, order, begin, end, text)
    each = pairs.select(*keys, F.explode_outer("errors").alias("x")).where(F.col("x").isNotNull())
    stats: list[Column] = [f(F.col("x")[w]).alias(f"{n}_{w}") for n, f in (("mean", F.avg), ("median", F.median), ("max", F.max)) for w in ("start", "end", "dur")]
    return each.groupBy(*keys).agg(F.count(F.lit(1)).alias("words"), *stats)
