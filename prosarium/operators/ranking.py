"""Positions per key without sending a key to one task, and joins on skewed or null keys.

A window over a key puts all its rows into one task. Here the key is cut into shards of an
ordered column; rows are numbered within their shard, and only the shard totals (one row each)
are accumulated over the whole key.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def sharded_row_number(df: DataFrame, keys: list[str], shard: Column, order: list[Column], out: str) -> DataFrame:
    """Adds `out`: the position (from 0) of each row within its keys.

    `shard` must rise with `order`, and one shard of one key must fit a task. Ties in `order` get
    some order among themselves. Null keys form a group of their own; an empty table stays empty.
    Columns named __shard or __before must not exist in df.
    """
    rows = df.withColumn("__shard", shard)
    by = [*keys, "__shard"]
    over = Window.partitionBy(*keys).orderBy("__shard")
    totals = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    before = totals.select(*by, (F.sum("__n").over(over) - F.col("__n")).alias("__before"))
    joined = null_safe_join(rows, before, by)
    return joined.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) + F.col("__before") - 1).drop("__shard", "__before")


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other; the keys come from the left, once."""
    other = right.select(*[F.col(c).alias(f"__r_{c}") if c in on else F.col(c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in on))
    joined = left.join(other, cond, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__r_{c}" for c in on])


def salted_join(left: DataFrame, right: DataFrame, on: str, spread: Column, salts: int = 16) -> DataFrame:
    """Left join with a small table on a skewed key: each right row is repeated `salts` times and the
    left rows of one key are spread over as many tasks. Null keys match null keys."""
    big = left.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    small = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return null_safe_join(big, small, [on, "__salt"], "left").drop("__salt")


def windowed_in_blocks(df: DataFrame, keys: list[str], shard: Column, order: list[Column], before: int, after: int, make: Callable[[WindowSpec], dict[str, Column]], block: int = 4096) -> DataFrame:
    """Adds make(window)'s columns, where the window holds `before` rows before and `after` rows after each row of
    its keys. A key's rows are cut into blocks by their position; each block also gets the rows within reach of its
    borders, so no key has to fit a task. shard and order as in sharded_row_number."""
    placed = sharded_row_number(df, keys, shard, order, "__pos")
    home = F.floor(F.col("__pos") / block)
    reach = F.array_distinct(F.array(home, F.greatest(F.lit(0), F.floor((F.col("__pos") - after) / block)), F.floor((F.col("__pos") + before) / block)))
    spread = placed.withColumn("__block", F.explode(reach))
    w = Window.partitionBy(*keys, "__block").orderBy("__pos").rowsBetween(-before, after)
    return spread.withColumns(make(w)).where(F.col("__block") == home).drop("__pos", "__block")
