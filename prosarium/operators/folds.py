"""Ordered recursions over long groups, cut into blocks.

A recursion from row to row looks as if a group had to sit in one task. Here a group is cut into
blocks of BLOCK rows; each block is summarised on its own, summaries are chained, and each block is
then finished with the state it starts from.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ranking import null_safe_join, sharded_row_number

BLOCK = 4096


def exponential_average(df: DataFrame, keys: list[str], order: list[Column], shard: Column, value: str, out: str, alpha: float = 0.2) -> DataFrame:
    """s_0 = x_0, s_i = alpha * x_i + (1 - alpha) * s_(i-1), in `order` within keys, not reset in between.

    Within a block the average starts from 0; what it had before decays by (1 - alpha)^(i + 1) and is added, with
    the last value of the block before (for alpha >= 0.01 what is older is below the precision of a DOUBLE).
    `shard` must rise with `order` and cut a group into parts that fit a task. Null values count as 0.
    """
    if alpha < 0.01:
        raise ValueError("alpha must be at least 0.01")
    placed = sharded_row_number(df, keys, shard, order, "__pos").withColumns({"__block": F.floor(F.col("__pos") / BLOCK), "__x": F.coalesce(F.col(value).cast("double"), F.lit(0.0))})
    def within(rows: Iterator[tuple[tuple, float]]) -> Iterator[float]:
        group, s = None, 0.0
        for g, v in rows:
            if g != group:
                group, s = g, 0.0
            s = alpha * v + (1 - alpha) * s
            yield s

    begun = cut_lineage(_along(placed, [*keys, "__block"], "__pos", "__x", within, out))
    last = begun.groupBy(*keys, (F.col("__block") + 1).alias("__block")).agg(F.max_by(out, "__pos").alias("__carry"))
    first = begun.where(F.col("__pos") == 0).select(*keys, F.lit(0).cast("bigint").alias("__block"), F.col("__x").alias("__carry"))
    carried = null_safe_join(begun, last.unionByName(first), [*keys, "__block"], "left")
    age = F.col("__pos") - F.col("__block") * BLOCK + 1
    return carried.withColumn(out, F.col(out) + F.pow(F.lit(1 - alpha), age) * F.coalesce(F.col("__carry"), F.lit(0.0))).drop("__pos", "__block", "__x", "__carry")


def limit_steps(df: DataFrame, keys: list[str], order: list[Column], shard: Column, value: str, out: str, most: float = 8.0) -> DataFrame:
    """y_0 = x_0; y_i is x_i, or at most `most` away from y_(i-1) towards it.

    As a function of the value it starts from, a block is a rising broken line with slopes 0 and 1. Blocks
    give their lines, the lines are applied one after the other per group (one row per BLOCK rows), and each
    block is then limited from its start value. Null values count as 0.
    """
    placed = cut_lineage(sharded_row_number(df, keys, shard, order, "__pos").withColumns({"__block": F.floor(F.col("__pos") / BLOCK), "__x": F.coalesce(F.col(value).cast("double"), F.lit(0.0))}))
    key_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields if f.name in keys)

    def line(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("__pos")["__x"].tolist()
        head = pdf.iloc[:1][[*keys, "__block"]].copy()
        xs, ys = compose_limits(x, most) if head["__block"].iloc[0] else ([0.0], [run_limit(x, most)[-1]])  # nothing comes before block 0
        head["xs"], head["ys"] = [xs], [ys]
        return head

    # Lines are only needed where a block follows.
    follows = placed.where(F.col("__pos") == F.col("__block") * BLOCK).where(F.col("__block") > 0).select(*keys, (F.col("__block") - 1).alias("__block"))
    lines = null_safe_join(placed, follows, [*keys, "__block"], "left_semi").groupBy(*keys, "__block").applyInPandas(line, f"{key_ddl}, `__block` bigint, xs array<double>, ys array<double>")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__block")
        state, states = float("nan"), []
        for b, xs, ys in zip(pdf["__block"], pdf["xs"], pdf["ys"]):
            state = float(ys[0]) if b == 0 else apply_line(list(xs), list(ys), state)
            states.append(state)
        return pdf[[*keys]].assign(__block=pdf["__block"] + 1, __state=states)

    starts = lines.groupBy(*keys).applyInPandas(chain, f"{key_ddl}, `__block` bigint, `__state` double")
    ready = null_safe_join(placed, starts, [*keys, "__block"], "left")
    # A block's start value stands before its first value, as one more row of the scan.
    ready = ready.withColumn("__in", F.when((F.col("__pos") == F.col("__block") * BLOCK) & F.col("__state").isNotNull(), F.least(F.greatest(F.col("__x"), F.col("__state") - most), F.col("__state") + most)).otherwise(F.col("__x")))

    def finish(rows: Iterator[tuple[tuple, float]]) -> Iterator[float]:
        group, state = None, 0.0
        for g, v in rows:
            if g != group:
                group, state = g, v
            state = v if abs(v - state) <= most else state + most if v > state else state - most
            yield state

    return _along(ready, [*keys, "__block"], "__pos", "__in", finish, out).drop("__pos", "__block", "__x", "__state", "__in")


def _along(df: DataFrame, by: list[str], order: str, value: str, scan: Callable[[Iterator[tuple[tuple, float]]], Iterator[float]], out: str) -> DataFrame:
    """Adds what scan yields for each (group, value), read in order; groups lie together, batch after batch."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = df.repartition(parts, *by).sortWithinPartitions(*by, order)
    schema = df.withColumn(out, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: deque[tuple[tuple, float]] = deque()
        results = scan(iter(rows.popleft, None))
        for b in batches:
            groups = list(zip(*[b.column(b.schema.get_field_index(k)).to_pylist() for k in by]))
            rows.extend(zip(groups, b.column(b.schema.get_field_index(value)).to_pylist()))
            got = [next(results) for _ in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.float64())], names=[*b.schema.names, out])

    return sorted_rows.mapInArrow(run, schema)


def run_limit(x: list[float], most: float, state: float | None = None) -> list[float]:
    out = []
    for v in x:
        if state is not None and abs(v - state) > most:
            v = state + most if v > state else state - most
        out.append(v)
        state = v
    return out


def apply_line(xs: list[float], ys: list[float], at: float) -> float:
    """Value of a broken line with slope 1 outside its knots."""
    i = bisect_left(xs, at)
    if i == 0:
        return ys[0] + (at - xs[0])
    if i == len(xs):
        return ys[-1] + (at - xs[-1])
    rise = ys[i] - ys[i - 1]
    return ys[i - 1] if rise == 0 else ys[i - 1] + (at - xs[i - 1]) * rise / (xs[i] - xs[i - 1])


def compose_limits(x: list[float], most: float) -> tuple[list[float], list[float]]:
    """Knots of start value -> value after limiting towards each of x in turn.

    One step maps y to y + most below x - most, to x within `most` of it, to y - most above. Knots
    whose values fall inside the middle collapse, so few are left.
    """
    xs, ys = [0.0], [0.0]  # the identity
    for v in x:
        lo, hi = v - most, v + most
        points = sorted({*_where(xs, ys, lo), *_where(xs, ys, hi), *xs})
        values = [apply_line(xs, ys, p) for p in points]
        moved = [y + most if y < lo else y - most if y > hi else v for y in values]
        xs, ys = [], []
        for i, (p, y) in enumerate(zip(points, moved)):
            if 0 < i < len(points) - 1 and moved[i - 1] == y == moved[i + 1]:
                continue
            xs.append(p)
            ys.append(y)
    return xs, ys


def _where(xs: list[float], ys: list[float], level: float) -> list[float]:
    """Places at which the line passes the level (the ends of the stretch if it stays there)."""
    if level <= ys[0]:
        return [xs[0] + (level - ys[0])]
    if level >= ys[-1]:
        return [xs[-1] + (level - ys[-1])]
    out = []
    for i in range(1, len(xs)):
        if ys[i - 1] <= level <= ys[i]:
            out += [xs[i - 1], xs[i]] if ys[i] == ys[i - 1] else [xs[i - 1] + (level - ys[i - 1]) * (xs[i] - xs[i - 1]) / (ys[i] - ys[i - 1])]
    return out


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], value: Column, start: Column, step: Callable[[Column, Column], Column], out: str) -> DataFrame:
    """One result per group by folding its rows in order, inside the JVM. For short groups (segments, sentences): a
    group is collected into one array."""
    sorted_rows = F.array_sort(F.collect_list(F.struct(*order, value.alias("__v"))))
    return df.groupBy(*keys).agg(F.aggregate(sorted_rows, start, lambda s, r: step(s, r["__v"])).alias(out))


def repair_overlaps(df: DataFrame, keys: list[str], begin: str, end: str, text: str, least: float = 0.01) -> DataFrame:
    """Intervals sorted by begin (then end and text); each begins no earlier than the previous, as repaired, ends, and
    lasts at least `least`. keys, i, xmin, xmax, mark. Groups are segments; each is folded in the JVM."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(begin).alias("b"), F.col(end).alias("e"), F.col(text).alias("t"))))
    none = F.array().cast("array<struct<xmin:double,xmax:double,mark:string>>")
    start = F.struct(F.lit(0.0).alias("last"), none.alias("out"))

    def step(s: Column, r: Column) -> Column:
        b = F.greatest(r["b"], s["last"])
        e = F.when(r["e"] <= b, b + least).otherwise(r["e"])
        return F.struct(e.alias("last"), F.concat(s["out"], F.array(F.struct(b.alias("xmin"), e.alias("xmax"), r["t"].alias("mark")))).alias("out"))

    folded = df.groupBy(*keys).agg(F.aggregate(rows, start, step, lambda s: s["out"]).alias("__a"))
    return folded.select(*keys, F.posexplode("__a").alias("i", "r")).select(*keys, "i", "r.*")


def gap_sessions(df: DataFrame, keys: list[str], begin: str, end: str, gap: float = 1.0, longest: float = 30.0) -> DataFrame:
    """Sessions of intervals in order of begin (then end); a new one starts after a gap of more than `gap` or when the
    current one already lasts more than `longest`. keys, s_start, s_end.

    A gap parts sessions whatever came before it, so runs between gaps are cut out by a window first; only within a run the
    rows are folded, in the JVM, and only the starts of its sessions are kept while folding."""
    w = Window.partitionBy(*keys).orderBy(begin, end)
    apart = F.coalesce(F.col(begin) - F.lag(end).over(w) > gap, F.lit(False)).cast("int")
    runs = df.select(*keys, begin, end).withColumn("__apart", apart).withColumn("__run", F.sum("__apart").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = F.array_sort(F.collect_list(F.struct(F.col(begin).alias("b"), F.col(end).alias("e"))))
    none = F.array().cast("array<struct<b:double,last:double>>")

    def step(s: Column, r: Column) -> Column:
        new = s["b"].isNull() | (s["e"] - s["b"] > longest)
        closed = F.when(new & s["b"].isNotNull(), F.concat(s["out"], F.array(F.struct(s["b"].alias("b"), s["e"].alias("last"))))).otherwise(s["out"])
        return F.struct(F.when(new, r["b"]).otherwise(s["b"]).alias("b"), r["e"].alias("e"), closed.alias("out"))

    start = F.struct(F.lit(None).cast("double").alias("b"), F.lit(None).cast("double").alias("e"), none.alias("out"))
    done = F.aggregate(rows, start, step, lambda s: F.concat(s["out"], F.array(F.struct(s["b"].alias("b"), s["e"].alias("last")))))
    return runs.groupBy(*keys, "__run").agg(done.alias("__a")).select(*keys, F.explode_outer("__a").alias("r")).select(*keys, F.col("r.b").alias("s_start"), F.col("r.last").alias("s_end"))
