"""Intervals per entity to continuous periods and the gaps between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ranking import null_safe_join

SHARD_MS = 600_000


def mend_intervals(df: DataFrame, begin: str, end: str, duration: str, usable_below: float = 600.0) -> DataFrame:
    """Adds b_ms and e_ms (BIGINT milliseconds) and drops rows whose interval cannot be known.

    A missing (null or NaN) begin or end follows from the other and a usable duration (above 0,
    below `usable_below` seconds); with both missing, or one missing without a usable duration, the
    row is dropped. A begin after its end is exchanged with it.
    """
    b, e, d = (F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in (begin, end, duration))
    d = F.when((d > 0) & (d < usable_below), d)
    ms = lambda c: F.round(c * 1000).cast("long")
    b, e = F.coalesce(ms(b), ms(e) - ms(d)), F.coalesce(ms(e), ms(b) + ms(d))
    return df.withColumns({"b_ms": F.least(b, e), "e_ms": F.greatest(b, e)}).where(b.isNotNull() & e.isNotNull())


def periods_and_gaps(df: DataFrame, entity: list[str], begin: str = "b_ms", end: str = "e_ms", tolerance: int = 10, shard: int = SHARD_MS) -> DataFrame:
    """entity columns, kind ('period' or 'gap'), begin_ms, end_ms.

    Starts and ends are ranked independently of each other: the rank of a place among the starts (ends)
    is the number of starts (ends) up to it. A gap follows the end of rank k where the start of rank k + 1
    lies beyond it, by more than `tolerance`: where both ranks of a place are k, the next start is that of rank k + 1. The
    first start, the last end and the two sides of each gap pair up to periods.

    All starts and ends of an entity at one millisecond are counted into one row before anything
    moves, and ranks run within time shards of `shard` ms, so a task never holds more than `shard`
    rows of an entity, whatever its size; only one row per shard is accumulated over the entity.
    Rows with a null begin or end are ignored; begin must not be after end (see mend_intervals).
    Null entity columns form an entity. Touching and nested intervals merge, repeated rows change
    nothing; a single interval gives one period and no gap; an empty table gives no rows.
    """
    named, entity = entity, [f"__k{i}" for i in range(len(entity))]
    df = df.select(*[F.col(c).alias(k) for c, k in zip(named, entity)], F.col(begin).alias("__begin"), F.col(end).alias("__end"))
    begin, end = "__begin", "__end"
    known = df.where(F.col(begin).isNotNull() & F.col(end).isNotNull()).select(*entity, F.col(begin).cast("long").alias("__b"), F.col(end).cast("long").alias("__e"))
    sides = F.explode(F.array(F.struct(F.col("__b").alias("at"), F.lit(1).alias("starts"), F.lit(0).alias("ends")), F.struct(F.col("__e").alias("at"), F.lit(0).alias("starts"), F.lit(1).alias("ends"))))
    marks = known.select(*entity, sides.alias("__side")).select(*entity, "__side.*").groupBy(*entity, "at").agg(F.sum("starts").alias("starts"), F.sum("ends").alias("ends")).withColumn("shard", F.floor(F.col("at") / shard))

    by = [*entity, "shard"]
    along = Window.partitionBy(*entity).orderBy("shard")
    totals = marks.groupBy(*by).agg(F.sum("starts").alias("starts"), F.sum("ends").alias("ends"), F.min("at").alias("first"), F.max("at").alias("last"))
    totals = totals.select(*by, *[(F.sum(c).over(along) - F.col(c)).alias(f"{c}_before") for c in ("starts", "ends")], F.lead("first").over(along).alias("next_first"), F.lag("last").over(along).alias("prev_last"))

    within = Window.partitionBy(*by).orderBy("at")
    running = within.rowsBetween(Window.unboundedPreceding, 0)
    rows = null_safe_join(marks, totals, by)
    rows = rows.withColumns({"start_rank": F.col("starts_before") + F.sum("starts").over(running), "end_rank": F.col("ends_before") + F.sum("ends").over(running), "next": F.coalesce(F.lead("at").over(within), F.col("next_first")), "prev": F.lag("at").over(within)})
    rows = rows.withColumn("gap_after", (F.col("start_rank") == F.col("end_rank")) & F.coalesce(F.col("next") - F.col("at") > tolerance, F.lit(False)))
    fresh = (F.col("starts_before") == F.col("ends_before")) & F.coalesce(F.col("at") - F.col("prev_last") > tolerance, F.lit(True))
    rows = rows.withColumns({"opens": F.when(F.col("prev").isNull(), fresh).otherwise(F.lag("gap_after").over(within)), "closes": F.col("gap_after") | F.col("next").isNull()})
    rows = rows.withColumn("since", F.last(F.when(F.col("opens"), F.col("at")), ignorenulls=True).over(running))
    borders = cut_lineage(rows.where(F.col("opens") | F.col("closes")).select(*by, "at", "next", "gap_after", "closes", "since", "opens"))

    # A period that began in an earlier shard takes its begin from the last shard in which one did.
    carried = borders.groupBy(*by).agg(F.max(F.when(F.col("opens"), F.col("at"))).alias("opened"))
    carried = carried.select(*by, F.last("opened", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    closing = borders.where("closes")
    here = closing.where(F.col("since").isNotNull()).select(*entity, F.lit("period").alias("kind"), F.col("since").alias("begin_ms"), F.col("at").alias("end_ms"))
    from_before = null_safe_join(closing.where(F.col("since").isNull()), carried, by).select(*entity, F.lit("period").alias("kind"), F.col("earlier").alias("begin_ms"), F.col("at").alias("end_ms"))
    gaps = borders.where("gap_after").select(*entity, F.lit("gap").alias("kind"), F.col("at").alias("begin_ms"), F.col("next").alias("end_ms"))
    out = here.unionByName(from_before).unionByName(gaps)
    return out.select(*[F.col(k).alias(c) for c, k in zip(named, entity)], "kind", "begin_ms", "end_ms")


def spoken(text: Column) -> Column:
    """The text has a character that is not Unicode white space; false for null."""
    return F.coalesce(text.rlike(r"[^\p{IsWhite_Space}]"), F.lit(False))
