"""Interval tables: words and pauses, chunks, gap filling, and joins on time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.text import has_word, is_blank


def _within(keys: list[str], *order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def words_and_pauses(df: DataFrame, keys: list[str], order: str = "idx", begin: str = "xmin", end: str = "xmax", mark: str = "mark", lead_in_ms: int = 150) -> DataFrame:
    """Adds kind ('word' or 'pause'), token and dur_ms; pauses shorter than `lead_in_ms` before the first
    word of the group are dropped. Times are rounded half to even. Groups are segments, which are short."""
    ms = lambda c: F.bround(F.col(c) * 1000, 0).cast("bigint")
    pause = is_blank(F.col(mark))
    earlier = F.max(~pause).over(_within(keys, order).rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumns({"kind": F.when(pause, "pause").otherwise("word"), "token": F.when(~pause, F.trim(mark)), "dur_ms": ms(end) - ms(begin), "__spoken": F.coalesce(earlier, F.lit(False))})
    return rows.where(~((F.col("kind") == "pause") & ~F.col("__spoken") & (F.col("dur_ms") < lead_in_ms))).drop("__spoken")


def without_false_pauses(df: DataFrame, keys: list[str], words: list[str], order: str = "idx") -> DataFrame:
    """Pauses right after a word of the given class are dropped."""
    w = _within(keys, order)
    bad = (F.col("kind") == "pause") & (F.lag("kind").over(w) == "word") & F.lower(F.lag("token").over(w)).isin(words)
    return df.withColumn("__bad", F.coalesce(bad, F.lit(False))).where(~F.col("__bad")).drop("__bad")


def sentence_pauses(df: DataFrame, keys: list[str], least_ms: int = 500, order: str = "idx") -> DataFrame:
    """A pause after a word that ends in . ? ! lasts at least `least_ms`; where none follows, one is put in.
    The new row has the word's order value and sub = 1, all others sub = 0."""
    w = _within(keys, order)
    ends = lambda c: F.coalesce(c.rlike(r"[.?!]$"), F.lit(False))
    after_end = (F.col("kind") == "pause") & (F.lag("kind").over(w) == "word") & ends(F.lag("token").over(w))
    clamped = df.withColumns({"__dur": F.when(F.coalesce(after_end, F.lit(False)), F.greatest("dur_ms", F.lit(least_ms))).otherwise(F.col("dur_ms")), "__lone": (F.col("kind") == "word") & ends(F.col("token")) & (F.coalesce(F.lead("kind").over(w), F.lit("")) != "pause")})
    own = F.struct(F.lit(0).alias("sub"), F.col("kind").alias("kind"), F.col("token").alias("token"), F.col("__dur").cast("bigint").alias("dur_ms"))
    put = F.struct(F.lit(1).alias("sub"), F.lit("pause").alias("kind"), F.lit(None).cast("string").alias("token"), F.lit(least_ms).cast("bigint").alias("dur_ms"))
    both = F.explode(F.when(F.col("__lone"), F.array(own, put)).otherwise(F.array(own)))
    return clamped.withColumn("__r", both).select(*[c for c in df.columns if c not in ("kind", "token", "dur_ms")], "__r.*")


def chunks(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Runs of words between pauses become one row each, every pause its own: keys, chunk_no, words,
    start_ms, end_ms, pause_ms. Times run from 0 per group, over words and pauses."""
    w = Window.partitionBy(*keys).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    pause = F.col("kind") == "pause"
    timed = df.withColumns({"__end": F.sum("dur_ms").over(run), "__island": F.sum(pause.cast("int")).over(run)})
    at = F.struct(*order, F.trim("token").alias("t"))
    made = timed.groupBy(*keys, "__island", pause.alias("__pause")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~pause, at))), lambda s: s["t"]), " ").alias("words"),
        F.min(F.col("__end") - F.col("dur_ms")).cast("bigint").alias("start_ms"), F.max("__end").cast("bigint").alias("end_ms"),
        F.coalesce(F.sum(F.when(pause, F.col("dur_ms"))), F.lit(0)).cast("bigint").alias("pause_ms"),
    )
    # Island n: its pause comes first, then its words.
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("__island", F.desc("__pause")))
    return made.withColumn("chunk_no", number).select(*keys, "chunk_no", "words", "start_ms", "end_ms", "pause_ms")


def pause_after(df: DataFrame, keys: list[str], order: str = "idx") -> DataFrame:
    """I8: words with the length of the pause right after each, null if none follows."""
    w = _within(keys, order)
    return df.withColumn("pause_after_ms", F.when(F.lead("kind").over(w) == "pause", F.lead("dur_ms").over(w))).where(F.col("kind") == "word")


def speech_runs(df: DataFrame, keys: list[str], order: str = "idx") -> DataFrame:
    """Runs of marked intervals: keys, run_no, words, and the length of the first silence after each (0 if none)."""
    w = _within(keys, order)
    blank = is_blank(F.col("mark"))
    rows = df.withColumns({"__blank": blank, "__run": F.sum((~blank & F.coalesce(F.lag(blank).over(w), F.lit(True))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)), "__after": F.when(~blank & F.lead(blank).over(w), F.bround((F.lead("xmax").over(w) - F.lead("xmin").over(w)) * 1000, 0).cast("bigint"))})
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.trim("mark").alias("t")))), lambda s: s["t"]), " ")
    return rows.where(~F.col("__blank")).groupBy(*keys, F.col("__run").alias("run_no")).agg(text.alias("words"), F.coalesce(F.max("__after"), F.lit(0)).cast("bigint").alias("silence_after_ms"))


def break_events(df: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """Rows without text whose previous row has a word; adds that row's text as `before`."""
    w = _within(keys, order)
    return df.withColumn("before", F.lag(text).over(w)).where(is_blank(F.col(text)) & has_word(F.col("before")))


def pause_table(df: DataFrame, keys: list[str], begin: str, end: str, order: str) -> DataFrame:
    """Adds gap_s to the next interval and pause_label, 'No Pause' up to 10 ms; the last of a group has no row."""
    gap = F.lead(begin).over(_within(keys, order)) - F.col(end)
    return df.withColumn("gap_s", gap).where(F.col("gap_s").isNotNull()).withColumn("pause_label", F.when(F.col("gap_s") > 0.01, F.format_string("%.2fs", "gap_s")).otherwise("No Pause"))


def fill_silences(df: DataFrame, keys: list[str], begin: str, end: str, text: str, order: str, least: float = 0.01) -> DataFrame:
    """Words with end <= begin are given `least` seconds, [*] becomes blank, and a blank interval is put where a
    word begins after the end of the previous one. keys, order, sub (0 silence, 1 word), xmin, xmax, mark."""
    fixed = df.withColumn("__e", F.when(F.col(end) <= F.col(begin), F.col(begin) + least).otherwise(F.col(end)))
    before = F.coalesce(F.lag("__e").over(_within(keys, order)), F.lit(0.0))
    word = F.struct(F.lit(1).alias("sub"), F.col(begin).alias("xmin"), F.col("__e").alias("xmax"), F.when(F.col(text) == "[*]", "").otherwise(F.col(text)).alias("mark"))
    hole = F.struct(F.lit(0).alias("sub"), F.col("__before").alias("xmin"), F.col(begin).alias("xmax"), F.lit("").alias("mark"))
    return fixed.withColumn("__before", before).withColumn("__r", F.explode(F.when(F.col(begin) > F.col("__before"), F.array(hole, word)).otherwise(F.array(word)))).select(*keys, order, "__r.*")


def clamp_starts(df: DataFrame, keys: list[str], begin: str, end: str, order: str) -> DataFrame:
    """Rows with null or empty intervals are dropped, a start before the previous end is moved to it."""
    ok = df.where(F.col(begin).isNotNull() & F.col(end).isNotNull() & (F.col(end) > F.col(begin)))
    return ok.withColumn(begin, F.greatest(F.col(begin), F.coalesce(F.lag(end).over(_within(keys, order)), F.col(begin))))


def close_small_gaps(df: DataFrame, keys: list[str], begin: str, end: str, order: str, least: float = 0.11) -> DataFrame:
    """I16: gaps up to `least` are closed by moving everything after them; greater ones stay. Adds shifted_begin, shifted_end, gap_before."""
    w = _within(keys, order)
    gap = F.round(F.col(begin) - F.coalesce(F.lag(end).over(w), F.lit(0.0)), 3)
    shift = F.sum(F.when(F.col("gap_before") <= least, F.col("gap_before")).otherwise(0.0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("gap_before", gap).withColumn("__s", shift).withColumns({"shifted_begin": F.round(F.col(begin) - F.col("__s"), 3), "shifted_end": F.round(F.col(end) - F.col("__s"), 3)}).drop("__s")


def ctm_intervals(df: DataFrame, keys: list[str], begin: str, end: str, mark: str, order: str, least: float = 0.11, tail: float = 0.5, close: bool = True) -> DataFrame:
    """I16: recogniser words as an interval tier without holes: keys, order, sub (0 silence, 1 word, 2 tail), xmin, xmax, mark.

    Gaps up to `least` are closed, greater ones become a blank interval, and a blank tail of `tail` seconds follows the last
    word. The plain variant (close=False) closes nothing, fills every gap and has no tail. Groups without rows have none."""
    moved = close_small_gaps(df, keys, begin, end, order, least) if close else df.withColumns({"shifted_begin": F.col(begin), "shifted_end": F.col(end), "gap_before": F.col(begin) - F.coalesce(F.lag(end).over(_within(keys, order)), F.lit(0.0))})
    b, e, gap = F.col("shifted_begin"), F.col("shifted_end"), F.col("gap_before")
    row = lambda sub, lo, hi, text: F.struct(F.lit(sub).alias("sub"), lo.alias("xmin"), hi.alias("xmax"), text.alias("mark"))
    word, hole = row(1, b, e, F.col(mark)), row(0, F.round(b - gap, 3), b, F.lit(""))
    after = row(2, e, F.round(e + tail, 3), F.lit(""))
    moved = moved.withColumn("__last", F.lead(order).over(_within(keys, order)).isNull() if close else F.lit(False))
    parts = F.concat(F.when(gap > (least if close else 0.0), F.array(hole)).otherwise(F.array().cast(_TIER)), F.array(word), F.when(F.col("__last"), F.array(after)).otherwise(F.array().cast(_TIER)))
    return moved.withColumn("__r", F.explode(parts)).select(*keys, order, "__r.*")


_TIER = "array<struct<sub:int,xmin:double,xmax:double,mark:string>>"


def pause_class(seconds: Column, thresholds: list[float]) -> Column:
    """I18: '::0' below a fifth of the first threshold, else '::k' with k one more than the number of thresholds reached."""
    c = F.when(seconds < thresholds[0] / 5, "::0")
    for i, t in enumerate(thresholds):
        c = c.when(seconds < t, f"::{i + 1}")
    return c.otherwise(f"::{len(thresholds) + 1}")


def forward_fill(df: DataFrame, keys: list[str], order: list[str], value: str, seed: Column) -> DataFrame:
    """Nulls take the last value before them, or the seed."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.coalesce(F.last(value, ignorenulls=True).over(w), seed))


def consecutive_runs(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """First, last and length of runs of consecutive numbers; repeated numbers count once."""
    once = df.select(*keys, number).where(F.col(number).isNotNull()).distinct()
    island = F.col(number) - F.row_number().over(_within(keys, number))
    return once.withColumn("__i", island).groupBy(*keys, "__i").agg(F.min(number).alias("first_no"), F.max(number).alias("last_no"), F.count(F.lit(1)).alias("n")).drop("__i")


def window_grid(df: DataFrame, keys: list[str], duration: str, width: int = 15) -> DataFrame:
    """Windows of `width` seconds from 0, the last cut to the duration."""
    starts = F.when(F.floor(duration) > 0, F.sequence(F.lit(0), (F.floor(duration) - 1).cast("int"), F.lit(width))).otherwise(F.array().cast("array<int>"))
    return df.select(*keys, F.col(duration), F.explode(starts).alias("w_start")).withColumn("w_end", F.least(F.col("w_start") + F.lit(float(width)), F.col(duration))).drop(duration)


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], lb: str, le: str, rb: str, re: str, bucket: float = 15.0) -> DataFrame:
    """Pairs of the same keys with lb < re and le > rb.

    Both sides are put into every bucket of `bucket` units that they touch and equi-joined there; a
    pair is kept in the bucket in which the later of the two begins, so none comes twice. Choose
    `bucket` near the usual length of an interval. Intervals with a null bound or without length touch nothing.
    """
    def spread(df: DataFrame, b: str, e: str) -> DataFrame:
        return df.where(F.col(e) > F.col(b)).withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(b) / bucket), F.floor(F.col(e) / bucket))))

    pairs = spread(left, lb, le).join(spread(right, rb, re), [*keys, "__bucket"])
    return pairs.where((F.col(lb) < F.col(re)) & (F.col(le) > F.col(rb)) & (F.floor(F.greatest(F.col(lb), F.col(rb)) / bucket) == F.col("__bucket"))).drop("__bucket")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, time: str, value: str, default: str = "unknown", order: list[str] | None = None) -> DataFrame:
    """Adds the value of the last right row of the same keys at or before `at`, or the default.

    Both sides are sorted together once, by one shuffle; no range condition, no product. Of right rows
    at the same time the greatest value counts. Left rows with a null time get the default.
    """
    marked = right.select(*keys, F.col(time).alias("__t"), F.struct(F.col(time), F.col(value)).alias("__v"), F.lit(0).alias("__side"))
    rows = left.withColumns({"__t": F.col(at), "__side": F.lit(1)}).unionByName(marked, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.col("__t"), F.col("__side"), F.col("__v")).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.withColumn("__last", F.last("__v", ignorenulls=True).over(w)).where(F.col("__side") == 1)
    return joined.withColumn(value, F.when(F.col(at).isNotNull(), F.coalesce(F.col("__last")[value], F.lit(default))).otherwise(F.lit(default))).drop("__t", "__side", "__v", "__last")


def even_spans(df: DataFrame, keys: list[str], text: str, duration: str, fallback: float = 3.0) -> DataFrame:
    """A10: the words of a text spread evenly over its duration (`fallback` if unknown)."""
    words = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
    d = F.coalesce(F.when(F.col(duration) > 0, F.col(duration)), F.lit(fallback))
    rows = df.select(*keys, d.alias("__d"), F.size(words).alias("__n"), F.posexplode(words).alias("i", "word"))
    return rows.select(*keys, "i", "word", (F.col("i") * F.col("__d") / F.col("__n")).alias("xmin"), ((F.col("i") + 1) * F.col("__d") / F.col("__n")).alias("xmax"))


def boundary_ends(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    """The next boundary as end, the last one its own time."""
    return df.withColumn("until", F.coalesce(F.lead(time).over(_within(keys, time)), F.col(time)))
