"""Queries of the interval, join and fold operators, with their SQL.

Intervals come from `events`: a user is a voice, five days are a segment, an event is an interval up
to the next one; errors and views are pauses. Chunks come from `bdd_syntagme_ssml`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import word_count
from ..operators import align, evaluation, folds, intervals
from ..operators.periods import spoken
from .tables import table

KEYS = ["voice", "segment"]


def events_as_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """voice, segment, idx, xmin, xmax, mark."""
    us = F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000
    mark = F.when(F.col("event_type").isin("error", "view"), "").when(F.col("event_id") % 3 == 0, F.concat("event_type", F.lit("."))).otherwise(F.col("event_type"))
    e = table(spark, folder, "events").select(F.col("user_id").alias("voice"), F.floor(us / 432000000000).alias("segment"), F.col("event_id").alias("idx"), (us / 1e6).alias("xmin"), mark.alias("mark"))
    return e.withColumn("xmax", F.coalesce(F.lead("xmin").over(intervals._within(KEYS, "idx")), F.col("xmin") + 1))


IV = """iv AS (
  SELECT voice, segment, idx, xmin, mark, coalesce(lead(xmin) OVER (PARTITION BY voice, segment ORDER BY idx), xmin + 1) AS xmax
  FROM (SELECT user_id AS voice, CAST(floor((epoch_us(ts) - 1704067200000000) / 432000000000) AS BIGINT) AS segment, event_id AS idx,
               (epoch_us(ts) - 1704067200000000) / 1e6 AS xmin,
               CASE WHEN event_type IN ('error', 'view') THEN '' WHEN event_id % 3 = 0 THEN event_type || '.' ELSE event_type END AS mark FROM events))"""
WP = (
    IV
    + """, wp AS (
  SELECT * FROM (SELECT *, CASE WHEN mark = '' THEN 'pause' ELSE 'word' END AS kind, CASE WHEN mark <> '' THEN mark END AS token,
    CAST(round_even(xmax * 1000, 0) AS BIGINT) - CAST(round_even(xmin * 1000, 0) AS BIGINT) AS dur_ms,
    coalesce(bool_or(mark <> '') OVER (PARTITION BY voice, segment ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS sp FROM iv)
  WHERE NOT (kind = 'pause' AND NOT sp AND dur_ms < 3600000))"""
)
I6 = (
    WP
    + """, i6 AS (SELECT voice, segment, idx, kind, token, dur_ms FROM (SELECT *, coalesce(kind = 'pause' AND lag(kind) OVER w = 'word' AND lower(lag(token) OVER w) IN ('signup', 'signup.'), false) AS bad
  FROM wp WINDOW w AS (PARTITION BY voice, segment ORDER BY idx)) WHERE NOT bad)"""
)
I7 = (
    I6
    + """, i7a AS (SELECT voice, segment, idx, kind, token,
    CASE WHEN kind = 'pause' AND lag(kind) OVER w = 'word' AND regexp_matches(lag(token) OVER w, '[.?!]$') THEN greatest(dur_ms, 5000000) ELSE dur_ms END AS dur_ms,
    kind = 'word' AND regexp_matches(token, '[.?!]$') AND coalesce(lead(kind) OVER w, '') <> 'pause' AS lone FROM i6 WINDOW w AS (PARTITION BY voice, segment ORDER BY idx)),
  i7 AS (SELECT voice, segment, idx, 0 AS sub, kind, token, dur_ms FROM i7a UNION ALL SELECT voice, segment, idx, 1, 'pause', NULL, 5000000 FROM i7a WHERE lone)"""
)


def _wp(spark: SparkSession, folder: str) -> DataFrame:
    return intervals.words_and_pauses(events_as_intervals(spark, folder), KEYS, lead_in_ms=3_600_000)


def _i6(spark: SparkSession, folder: str) -> DataFrame:
    return intervals.without_false_pauses(_wp(spark, folder), KEYS, ["signup", "signup."])


def _i7(spark: SparkSession, folder: str) -> DataFrame:
    return intervals.sentence_pauses(_i6(spark, folder).select(*KEYS, "idx", "kind", "token", "dur_ms"), KEYS, least_ms=5_000_000)


def i1_words_and_pauses(spark, folder):
    return _wp(spark, folder).select(*KEYS, "idx", "kind", "token", "dur_ms")


def i6_without_false_pauses(spark, folder):
    return _i6(spark, folder).select(*KEYS, "idx", "kind", "token", "dur_ms")


def i7_sentence_pauses(spark, folder):
    return _i7(spark, folder)


def i5_chunks(spark, folder):
    return intervals.chunks(_i7(spark, folder), KEYS, ["idx", "sub"])


def i8_pause_after(spark, folder):
    return intervals.pause_after(_wp(spark, folder), KEYS).select(*KEYS, "idx", "token", "pause_after_ms")


def i9_speech_runs(spark, folder):
    return intervals.speech_runs(events_as_intervals(spark, folder), KEYS)


def i2_fill_silences(spark, folder):
    iv = events_as_intervals(spark, folder).withColumns({"xmax": F.when(F.col("idx") % 7 == 0, F.col("xmin")).otherwise(F.col("xmax") - 60), "mark": F.when(F.col("mark") == "", "[*]").otherwise(F.col("mark"))})
    return intervals.fill_silences(iv, KEYS, "xmin", "xmax", "mark", "idx").select(*KEYS, "idx", "sub", F.round("xmin", 4).alias("xmin"), F.round("xmax", 4).alias("xmax"), "mark")


def i11_pause_table(spark, folder):
    iv = events_as_intervals(spark, folder).withColumn("xmax", F.when(F.col("idx") % 4 == 0, F.col("xmax")).otherwise(F.col("xmin") + 5))
    t = intervals.pause_table(iv, KEYS, "xmin", "xmax", "idx")
    return t.select(*KEYS, "idx", F.round("gap_s", 4).alias("gap_s"), (F.col("pause_label") == "No Pause").alias("no_pause"))


def i13_window_grid(spark, folder):
    """The grid over whole segments: from 0 to the last usable end of a chunk."""
    c = table(spark, folder, "bdd_syntagme_ssml").select(*KEYS, F.col("end_syntagme_natural").alias("e")).where("e > 0 AND e < double('infinity')")  # NaN is above infinity
    return intervals.window_grid(c.groupBy(*KEYS).agg(F.max("e").alias("dur")), KEYS, "dur").select(*KEYS, "w_start", F.round("w_end", 4).alias("w_end"))


def i14_consecutive_runs(spark, folder):
    d = table(spark, folder, "bdd_ssml").select("voice", F.col("seg_no").cast("bigint").alias("seg_no"))
    return intervals.consecutive_runs(d, ["voice"], "seg_no")


def i16_ctm_intervals(spark, folder):
    cut = lambda c: F.floor(F.col(c) * 1000) / 1000
    iv = events_as_intervals(spark, folder).withColumns({"xmin": cut("xmin"), "xmax": F.when(F.col("idx") % 2 == 0, cut("xmax") - 0.05).otherwise(cut("xmax") - 0.5)})
    t = intervals.ctm_intervals(iv, KEYS, "xmin", "xmax", "mark", "idx")
    return t.select(*KEYS, "idx", "sub", F.round("xmin", 3).alias("xmin"), F.round("xmax", 3).alias("xmax"), "mark")


def i16_plain_intervals(spark, folder):
    t = intervals.ctm_intervals(events_as_intervals(spark, folder).withColumn("xmax", F.col("xmax") - 0.05), KEYS, "xmin", "xmax", "mark", "idx", close=False)
    return t.select(*KEYS, "idx", "sub", F.round("xmin", 3).alias("xmin"), F.round("xmax", 3).alias("xmax"), "mark")


def i17_clamp_starts(spark, folder):
    iv = events_as_intervals(spark, folder).withColumn("xmax", F.when(F.col("idx") % 5 == 0, F.lit(None)).when(F.col("idx") % 5 == 1, F.col("xmin")).otherwise(F.col("xmax") + 0.25))
    return intervals.clamp_starts(iv, KEYS, "xmin", "xmax", "idx").select(*KEYS, "idx", F.round("xmin", 4).alias("xmin"), F.round("xmax", 4).alias("xmax"))


def i18_pause_classes(spark, folder):
    c = table(spark, folder, "bdd_syntagme_ssml").where(~spoken(F.col("syntagme")))
    return c.select("row_id", intervals.pause_class(F.col("duration_pause_syntagme_natural"), [0.2, 0.5, 1.0]).alias("pause_class"))


def i19_forward_fill(spark, folder):
    e = events_as_intervals(spark, folder).select(*KEYS, "idx", F.when(F.col("mark") != "", F.col("idx")).alias("seg_id"))
    return intervals.forward_fill(e, KEYS, ["idx"], "seg_id", F.lit(-1))


def i21_boundary_ends(spark, folder):
    r = events_as_intervals(spark, folder).groupBy(*KEYS, F.floor(F.col("xmin") / 60).alias("minute")).agg(F.min("xmin").alias("t"))
    return intervals.boundary_ends(r, KEYS, "t").select(*KEYS, F.round("t", 4).alias("t"), F.round("until", 4).alias("until"))


def i10_break_events(spark, folder):
    c = table(spark, folder, "bdd_syntagme_ssml").groupBy(*KEYS, "syn_no").agg(F.min("syntagme").alias("syntagme"), F.min("row_id").alias("row_id"))
    return intervals.break_events(c, KEYS, "syn_no", "syntagme").select("row_id", *KEYS, "before")


def i4_legacy_chunks(spark, folder):
    """I4: islands of a segment's rows between pauses: first begin, last end, summed duration, joined text; pauses their own rows."""
    from pyspark.sql import Window

    c = table(spark, folder, "lineitem").select((F.col("l_orderkey") % 2000).alias("segment"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"), "l_suppkey", "l_partkey", "l_quantity", "l_linestatus", "l_returnflag")
    c = c.groupBy("segment", "at").agg(F.min(F.struct("l_suppkey", "l_quantity", "l_returnflag")).alias("r")).select("segment", "at", "r.*")
    pause = F.col("l_suppkey") % 4 == 0
    rows = c.withColumns({"pause": pause, "island": F.sum(pause.cast("int")).over(Window.partitionBy("segment").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))})
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "l_returnflag"))), lambda s: s["l_returnflag"]), " ")
    return rows.groupBy("segment", "island", "pause").agg(F.when(F.col("pause"), "").otherwise(text).alias("syntagme"), F.min("at").alias("begin_at"), F.max("at").alias("end_at"), F.round(F.sum("l_quantity"), 2).alias("duration"))


def j9_overlap_join(spark, folder):
    """Spoken chunks against 2-second windows of their segment."""
    c = table(spark, folder, "bdd_syntagme_ssml").where(spoken(F.col("syntagme")))
    c = c.select("row_id", *KEYS, F.col("begin_syntagme_natural").alias("b"), F.col("end_syntagme_natural").alias("e")).where("b >= 0 AND e > b AND e < 600")
    d = c.groupBy(*KEYS).agg(F.max("e").alias("dur"))
    return intervals.overlap_join(c, intervals.window_grid(d, KEYS, "dur", 2), KEYS, "b", "e", "w_start", "w_end", bucket=2.0).select("row_id", *KEYS, "w_start")


def j11_asof_join(spark, folder):
    iv = events_as_intervals(spark, folder)
    words, bounds = iv.where("mark <> ''").select(*KEYS, "idx", F.col("xmin").alias("at")), iv.where("mark = ''").select(*KEYS, F.col("xmin").alias("b_at"), F.col("idx").cast("string").alias("label"))
    return intervals.asof_join(words, bounds, KEYS, "at", "b_at", "label").select(*KEYS, "idx", "label")


def a10_even_spans(spark, folder):
    s = table(spark, folder, "bdd_ssml").select("row_id", "syntagme", F.when(F.col("seg_no") % 3 != 0, F.col("seg_no").cast("double")).alias("d"))
    return intervals.even_spans(s, ["row_id"], "syntagme", "d").select("row_id", "i", "word", F.round("xmin", 4).alias("xmin"), F.round("xmax", 4).alias("xmax"))


def a6_repair_overlaps(spark, folder):
    iv = events_as_intervals(spark, folder).withColumn("xmax", F.when(F.col("idx") % 3 == 0, F.col("xmin")).otherwise(F.col("xmax") + 1000))
    return folds.repair_overlaps(iv, KEYS, "xmin", "xmax", "mark").select(*KEYS, "i", F.round("xmin", 3).alias("xmin"), F.round("xmax", 3).alias("xmax"), "mark")


def i12_gap_sessions(spark, folder):
    iv = events_as_intervals(spark, folder).withColumn("xmax", F.col("xmin") + 600)
    return folds.gap_sessions(iv, ["voice"], "xmin", "xmax", gap=20000.0, longest=90000.0).select("voice", F.round("s_start", 4).alias("s_start"), F.round("s_end", 4).alias("s_end"))


def _series(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(F.col("user_id").alias("voice"), F.col("event_id").alias("pos"), "value")


def w3_exponential_average(spark, folder):
    s = folds.exponential_average(_series(spark, folder), ["voice"], [F.col("pos")], F.floor(F.col("pos") / 4096), "value", "smooth")
    return s.select("voice", "pos", F.round("smooth", 4).alias("smooth"))


def w4_limit_steps(spark, folder):
    s = folds.limit_steps(_series(spark, folder), ["voice"], [F.col("pos")], F.floor(F.col("pos") / 4096), "value", "limited", most=8.0)
    return s.select("voice", "pos", F.round("limited", 4).alias("limited"))


def a4_levenshtein(spark, folder):
    """Edit distance of whole texts: characters of any script count, only the mark-up is dropped. No SQL, as DuckDB counts bytes."""
    p = table(spark, folder, "predictions").where(F.col("input_text").isNotNull() & F.col("gold_ssml").isNotNull())
    return p.select("pred_id", F.levenshtein("input_text", F.regexp_replace("gold_ssml", "<[^>]+>", "")).alias("distance"))


def i20_break_labels(spark, folder):
    """1 on the last word of a text element before a break, 0 on the other words."""
    from ..operators.corpus import canonical_sequence

    c = table(spark, folder, "corpus").select("record_id", canonical_sequence(F.col("parsed_sequence")).alias("s"))
    e = c.select("record_id", F.posexplode("s").alias("i", "e"), "s").select("record_id", "i", F.col("e.type").alias("type"), F.filter(F.split(F.trim("e.text"), r"\s+"), lambda w: w != "").alias("words"), F.when(F.col("i") + 1 < F.size("s"), F.get("s", F.col("i") + 1)["type"]).alias("next"))
    w = e.where("type = 'text'").select("record_id", "i", "next", F.size("words").alias("n"), F.posexplode("words").alias("k", "word"))
    return w.select("record_id", "i", "k", "word", ((F.col("k") == F.col("n") - 1) & (F.coalesce("next", F.lit("")) == "break")).cast("int").alias("label"))


def i3_segment_ids(spark, folder):
    """Ids in order within a segment, with durations."""
    from pyspark.sql import Window

    iv = events_as_intervals(spark, folder)
    n = F.row_number().over(Window.partitionBy(*KEYS).orderBy("idx"))
    return iv.select("idx", F.concat(F.col("voice").cast("string"), F.lit("_"), F.col("segment").cast("string"), F.lit("_segment_"), n.cast("string")).alias("phrase_id"), F.round(F.col("xmax") - F.col("xmin"), 4).alias("duration"))


def a1_alignment_pairs(spark, folder):
    """Global alignment of each segment's natural words (chunk texts) with those of its SSML text. No SQL: dynamic programme."""
    nat = table(spark, folder, "bdd_syntagme_ssml").where(spoken(F.col("syntagme"))).select(*KEYS, F.col("row_id").alias("o"), F.col("syntagme").alias("t"))
    ref = table(spark, folder, "bdd_ssml").where(spoken(F.col("syntagme"))).select(*KEYS, F.posexplode(F.split("syntagme", " ")).alias("o", "t"))
    nat = nat.select(*KEYS, "o", F.posexplode(F.split("t", " ")).alias("k", "t")).select(*KEYS, (F.col("o") * 1000 + F.col("k")).alias("o"), "t")
    return align.align_tables(nat, ref, KEYS, "o", "t")


def a2_a3_chunk_matches(spark, folder):
    """Best-similarity matching of a prediction's segments with the texts of its input, and the spans they own."""
    p = table(spark, folder, "predictions").where(F.col("params").isNotNull() & F.col("input_text").isNotNull())
    left = p.select("pred_id", F.posexplode(F.filter(F.transform("params.segments", lambda s: s["text"]), lambda t: t.isNotNull())).alias("o", "t"))
    right = p.select("pred_id", F.posexplode(F.split("input_text", r"(?<=[.!?…,])\s+")).alias("o", "t"))
    m = align.match_chunks(left, right, ["pred_id"], "o", "t")
    return align.spans_of_matches(m.drop("similarity"), ["pred_id"], right.groupBy("pred_id").agg(F.count(F.lit(1)).cast("int").alias("n_right")))


def a5_merged_words(spark, folder):
    """Two tiers of each segment's words, one with long words cut in two and a blank between, brought together. No SQL: sequential."""
    p = table(spark, folder, "bdd_ssml").where(spoken(F.col("syntagme")))
    words = F.split("syntagme", " ")
    split = F.flatten(F.transform(words, lambda w: F.when(F.length(w) > 8, F.array(F.substring(w, 1, 4), F.lit(" "), F.substring(w, F.lit(5), F.length(w)))).otherwise(F.array(w))))
    tier = lambda a: F.transform(a, lambda w, i: F.struct(w.alias("mark"), (i * 0.5).cast("double").alias("xmin"), (i * 0.5 + 0.5).cast("double").alias("xmax")))
    return align.merged_tiers(p, ["row_id"], tier(split), tier(words))


def a7_a8_text_scores(spark, folder):
    p = table(spark, folder, "predictions").where(F.col("input_text").isNotNull() & F.col("params").isNotNull())
    said = F.array_join(F.filter(F.transform("params.segments", lambda s: s["text"]), lambda t: t.isNotNull()), " ")
    return p.select("pred_id", F.round(align.text_similarity(F.col("input_text"), said), 6).alias("similarity"), F.round(align.word_error_rate(F.col("input_text"), said), 6).alias("wer"))


def a9_contour_distance(spark, folder):
    c = table(spark, folder, "bdd_syntagme_ssml").where(spoken(F.col("syntagme"))).groupBy(*KEYS).agg(*[F.transform(F.array_sort(F.collect_list(F.struct("syn_no", F.col(f).alias("f")))), lambda s: s["f"]).alias(f) for f in ("natural_pitch_syntagme", "synthesized_pitch_syntagme")])
    return c.select(*KEYS, F.round(align.pitch_contour_distance(F.col("natural_pitch_syntagme"), F.col("synthesized_pitch_syntagme")), 6).alias("rmse"))


def j14_best_words(spark, folder):
    c = table(spark, folder, "predictions").where(F.col("input_text").isNotNull() & F.col("gold_ssml").isNotNull())
    words = c.select("pred_id", F.split(F.lower("input_text"), " ").alias("s"), F.split(F.lower(F.trim(F.regexp_replace("gold_ssml", "<[^>]+>", " "))), " +").alias("n"))
    return align.best_word(words, ["pred_id"], "s", "n")


def j15_greedy_matches(spark, folder):
    from ..functions.text import without_punctuation

    c = table(spark, folder, "predictions").where(F.col("input_text").isNotNull() & F.col("params").isNotNull())
    gold = c.select("pred_id", F.posexplode(F.split("input_text", r"(?<=[.!?…])\s+")).alias("o", "t")).withColumn("t", without_punctuation(F.col("t")))
    pred = c.select("pred_id", F.posexplode(F.filter(F.transform("params.segments", lambda s: s["text"]), lambda t: t.isNotNull())).alias("o", "t")).withColumn("t", without_punctuation(F.col("t")))
    return align.greedy_match(gold, pred, ["pred_id"], "o", "t")


def j16_break_scores(spark, folder):
    c = table(spark, folder, "bdd_syntagme_ssml").where(spoken(F.col("syntagme"))).groupBy(*KEYS).agg(F.array_sort(F.collect_list("end_syntagme_natural")).alias("ref"), F.array_sort(F.collect_list("end_syntagme_synthesized")).alias("sys"))
    s = align.break_scores(c, "ref", "sys")
    return s.select(*KEYS, "hits", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")])


def g19_g20_interval_errors(spark, folder):
    """Errors of synthetic against natural times, entire and per 15-segment window: recall, MAE and RMSE of start, end, duration."""
    from ..functions.metrics import mae, rmse

    c = table(spark, folder, "bdd_syntagme_ssml").where(spoken(F.col("syntagme")))
    t = lambda c: F.when((F.col(c) >= 0) & (F.col(c) < 600), F.col(c))
    v = c.select("voice", F.regexp_extract("segment", r"(\d+)$", 1).cast("int").alias("no"), t("begin_syntagme_natural").alias("gb"), t("end_syntagme_natural").alias("ge"), t("begin_syntagme_synthesized").alias("pb"), t("end_syntagme_synthesized").alias("pe"))
    v = v.withColumn("ok", F.col("gb").isNotNull() & F.col("ge").isNotNull() & F.col("pb").isNotNull() & F.col("pe").isNotNull())
    when = lambda c: F.when(F.col("ok"), c)
    gb, ge, pb, pe = (when(F.col(x)) for x in ("gb", "ge", "pb", "pe"))
    aggs = [F.avg(F.col("ok").cast("int")).alias("arr"), mae(gb, pb).alias("mae_start"), rmse(gb, pb).alias("rmse_start"), mae(ge, pe).alias("mae_end"), rmse(ge, pe).alias("rmse_end"), mae(ge - gb, pe - pb).alias("mae_dur"), rmse(ge - gb, pe - pb).alias("rmse_dur")]
    whole = v.groupBy("voice", F.lit("entire").alias("level"), F.lit(0).cast("bigint").alias("part")).agg(*aggs)
    parts = v.groupBy("voice", F.lit("window").alias("level"), F.floor(F.col("no") / 15).alias("part")).agg(*aggs)
    r = whole.unionByName(parts)
    return r.select("voice", "level", "part", *[F.round(c, 4).alias(c) for c in r.columns[3:]])


def _sides(spark, folder):
    """Natural chunks of each segment as gold, synthesized ones as predicted intervals, with the sentences of the latter."""
    c = table(spark, folder, "bdd_syntagme_ssml").where(spoken(F.col("syntagme")))
    usable = lambda c: F.when((F.col(c) >= 0) & (F.col(c) < 600), F.col(c))
    side = lambda kind: c.select(*KEYS, F.col("row_id").alias("o"), usable(f"begin_syntagme_{kind}").alias("b"), usable(f"end_syntagme_{kind}").alias("e"), F.col("syntagme").alias("t")).where("e > b")
    gold, pred = side("natural"), side("synthesized")
    sentences = folds.gap_sessions(pred, KEYS, "b", "e").withColumn("s_no", F.round(F.col("s_start") * 1000).cast("bigint"))
    return gold, pred, sentences


def g20_interval_levels(spark, folder):
    """Errors on the levels of the whole segment, 15-second windows and sentences, summed up by level. No SQL: greedy pairs."""
    gold, pred, sentences = _sides(spark, folder)
    r = evaluation.level_summary(evaluation.interval_errors(gold, pred, KEYS, "o", "b", "e", "t", sentences=sentences), ["voice"])
    return r.select("voice", "level", "parts", *[F.round(c, 6).alias(c) for c in r.columns[3:]])


def g20_word_errors(spark, folder):
    gold, pred, _ = _sides(spark, folder)
    r = evaluation.word_errors(gold, pred, KEYS, "o", "b", "e", "t")
    return r.select(*KEYS, "words", *[F.round(c, 6).alias(c) for c in r.columns[3:]])


QUERIES = {
    f.__name__: f
    for f in (
        i1_words_and_pauses, i2_fill_silences, i3_segment_ids, i4_legacy_chunks, i5_chunks, i6_without_false_pauses, i7_sentence_pauses, i8_pause_after, i9_speech_runs, i10_break_events,
        i11_pause_table, i12_gap_sessions, i13_window_grid, i14_consecutive_runs, i16_ctm_intervals, i16_plain_intervals, i17_clamp_starts, i18_pause_classes, i19_forward_fill, i20_break_labels, i21_boundary_ends,
        j9_overlap_join, j11_asof_join, j14_best_words, j15_greedy_matches, j16_break_scores, a1_alignment_pairs, a2_a3_chunk_matches, a4_levenshtein, a5_merged_words, a6_repair_overlaps,
        a7_a8_text_scores, a9_contour_distance, a10_even_spans, w3_exponential_average, w4_limit_steps, g19_g20_interval_errors, g20_interval_levels, g20_word_errors,
    )
}

_SPOKEN = r"regexp_matches(syntagme, '[^\s\x{85}\x{A0}\x{202F}\x{2009}\x{3000}]')"
_W = "WINDOW w AS (PARTITION BY voice, segment ORDER BY idx)"
_STEP = lambda fold: f"""
    WITH RECURSIVE n AS (SELECT user_id AS voice, event_id AS pos, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
    r AS (SELECT voice, pos, k, value AS s FROM n WHERE k = 1 UNION ALL SELECT n.voice, n.pos, n.k, {fold} FROM r JOIN n ON n.voice = r.voice AND n.k = r.k + 1)"""  # noqa: E731

SQL = {
    "i1_words_and_pauses": f"WITH {WP} SELECT voice, segment, idx, kind, token, dur_ms FROM wp",
    "i6_without_false_pauses": f"WITH {I6} SELECT * FROM i6",
    "i7_sentence_pauses": f"WITH {I7} SELECT * FROM i7",
    "i5_chunks": f"""WITH {I7}, t AS (SELECT *, sum(dur_ms) OVER w AS e, sum(CASE WHEN kind = 'pause' THEN 1 ELSE 0 END) OVER w AS island FROM i7 WINDOW w AS (PARTITION BY voice, segment ORDER BY idx, sub ROWS UNBOUNDED PRECEDING)),
        m AS (SELECT voice, segment, island, kind, coalesce(string_agg(token, ' ' ORDER BY idx, sub), '') AS words, CAST(min(e - dur_ms) AS BIGINT) AS start_ms, CAST(max(e) AS BIGINT) AS end_ms, CAST(sum(CASE WHEN kind = 'pause' THEN dur_ms ELSE 0 END) AS BIGINT) AS pause_ms FROM t GROUP BY ALL)
        SELECT voice, segment, CAST(row_number() OVER (PARTITION BY voice, segment ORDER BY island, kind) AS INTEGER) AS chunk_no, words, start_ms, end_ms, pause_ms FROM m""",
    "i8_pause_after": f"WITH {WP} SELECT voice, segment, idx, token, pause_after_ms FROM (SELECT *, CASE WHEN lead(kind) OVER w = 'pause' THEN lead(dur_ms) OVER w END AS pause_after_ms FROM wp {_W}) WHERE kind = 'word'",
    "i9_speech_runs": f"""WITH {IV}, a AS (SELECT *, mark = '' AS b, CASE WHEN mark <> '' AND lead(mark) OVER w = '' THEN CAST(round_even((lead(xmax) OVER w - lead(xmin) OVER w) * 1000, 0) AS BIGINT) END AS aft,
          CASE WHEN mark <> '' AND coalesce(lag(mark) OVER w = '', true) THEN 1 ELSE 0 END AS st FROM iv {_W}),
        c AS (SELECT *, sum(st) OVER (PARTITION BY voice, segment ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM a)
        SELECT voice, segment, CAST(run AS BIGINT) AS run_no, string_agg(mark, ' ' ORDER BY idx) AS words, coalesce(max(aft), 0) AS silence_after_ms FROM c WHERE NOT b GROUP BY voice, segment, run""",
    "i2_fill_silences": f"""WITH {IV}, a AS (SELECT voice, segment, idx, xmin, CASE WHEN idx % 7 = 0 THEN xmin ELSE xmax - 60 END AS x, CASE WHEN mark = '' THEN '' ELSE mark END AS mark FROM iv),
        f AS (SELECT *, CASE WHEN x <= xmin THEN xmin + 0.01 ELSE x END AS e FROM a), g AS (SELECT *, coalesce(lag(e) OVER w, 0) AS before FROM f {_W})
        SELECT voice, segment, idx, 1 AS sub, round(xmin, 4) AS xmin, round(e, 4) AS xmax, mark FROM g UNION ALL SELECT voice, segment, idx, 0, round(before, 4), round(xmin, 4), '' FROM g WHERE xmin > before""",
    "i11_pause_table": f"""WITH {IV}, a AS (SELECT voice, segment, idx, xmin, CASE WHEN idx % 4 = 0 THEN xmax ELSE xmin + 5 END AS e FROM iv), g AS (SELECT *, lead(xmin) OVER w - e AS gap FROM a {_W})
        SELECT voice, segment, idx, round(gap, 4) AS gap_s, NOT gap > 0.01 AS no_pause FROM g WHERE gap IS NOT NULL""",
    "i13_window_grid": """WITH d AS (SELECT voice, segment, max(end_syntagme_natural) AS dur FROM bdd_syntagme_ssml WHERE isfinite(end_syntagme_natural) AND end_syntagme_natural > 0 GROUP BY ALL)
        SELECT voice, segment, w_start, round(least(w_start + 15.0, dur), 4) AS w_end FROM (SELECT voice, segment, dur, CAST(unnest(range(0, CAST(floor(dur) AS BIGINT), 15)) AS INTEGER) AS w_start FROM d)""",
    "i14_consecutive_runs": "SELECT voice, min(s) AS first_no, max(s) AS last_no, count(*) AS n FROM (SELECT voice, s, s - row_number() OVER (PARTITION BY voice ORDER BY s) AS i FROM (SELECT DISTINCT voice, CAST(seg_no AS BIGINT) AS s FROM bdd_ssml WHERE seg_no IS NOT NULL)) GROUP BY voice, i",
    "i16_ctm_intervals": f"""WITH {IV}, a AS (SELECT voice, segment, idx, mark, floor(xmin * 1000) / 1000 AS xmin, CASE WHEN idx % 2 = 0 THEN floor(xmax * 1000) / 1000 - 0.05 ELSE floor(xmax * 1000) / 1000 - 0.5 END AS e FROM iv), g AS (SELECT *, round(xmin - coalesce(lag(e) OVER w, 0), 3) AS gap, lead(idx) OVER w IS NULL AS last FROM a {_W}),
        s AS (SELECT *, sum(CASE WHEN gap <= 0.11 THEN gap ELSE 0 END) OVER (PARTITION BY voice, segment ORDER BY idx ROWS UNBOUNDED PRECEDING) AS s FROM g)
        SELECT voice, segment, idx, 1 AS sub, round(xmin - s, 3) AS xmin, round(e - s, 3) AS xmax, mark FROM s
        UNION ALL SELECT voice, segment, idx, 0, round(xmin - s - gap, 3), round(xmin - s, 3), '' FROM s WHERE gap > 0.11
        UNION ALL SELECT voice, segment, idx, 2, round(e - s, 3), round(e - s + 0.5, 3), '' FROM s WHERE last""",
    "i16_plain_intervals": f"""WITH {IV}, a AS (SELECT voice, segment, idx, mark, xmin, xmax - 0.05 AS e FROM iv), g AS (SELECT *, coalesce(lag(e) OVER w, 0) AS before FROM a {_W})
        SELECT voice, segment, idx, 1 AS sub, round(xmin, 3) AS xmin, round(e, 3) AS xmax, mark FROM g UNION ALL SELECT voice, segment, idx, 0, round(before, 3), round(xmin, 3), '' FROM g WHERE xmin - before > 0""",
    "i17_clamp_starts": f"""WITH {IV}, a AS (SELECT voice, segment, idx, xmin, CASE idx % 5 WHEN 0 THEN NULL WHEN 1 THEN xmin ELSE xmax + 0.25 END AS e FROM iv), b AS (SELECT * FROM a WHERE e > xmin)
        SELECT voice, segment, idx, round(greatest(xmin, coalesce(lag(e) OVER w, xmin)), 4) AS xmin, round(e, 4) AS xmax FROM b {_W}""",
    "i18_pause_classes": f"""SELECT row_id, CASE WHEN d < 0.2 / 5 THEN '::0' WHEN d < 0.2 THEN '::1' WHEN d < 0.5 THEN '::2' WHEN d < 1.0 THEN '::3' ELSE '::4' END AS pause_class
        FROM (SELECT row_id, duration_pause_syntagme_natural AS d FROM bdd_syntagme_ssml WHERE NOT coalesce({_SPOKEN}, false))""",
    "i19_forward_fill": f"WITH {IV} SELECT voice, segment, idx, coalesce(last_value(CASE WHEN mark <> '' THEN idx END IGNORE NULLS) OVER (PARTITION BY voice, segment ORDER BY idx ROWS UNBOUNDED PRECEDING), -1) AS seg_id FROM iv",
    "i21_boundary_ends": f"WITH {IV}, r AS (SELECT voice, segment, floor(xmin / 60) AS m, min(xmin) AS t FROM iv GROUP BY ALL) SELECT voice, segment, round(t, 4) AS t, round(coalesce(lead(t) OVER (PARTITION BY voice, segment ORDER BY t), t), 4) AS until FROM r",
    "i10_break_events": r"""WITH c AS (SELECT voice, segment, syn_no, min(syntagme) AS s, min(row_id) AS row_id FROM bdd_syntagme_ssml GROUP BY ALL), l AS (SELECT *, lag(s) OVER (PARTITION BY voice, segment ORDER BY syn_no) AS before FROM c)
        SELECT row_id, voice, segment, before FROM l WHERE trim(coalesce(s, '')) = '' AND regexp_matches(before, '[\p{L}\p{N}_]')""",
    "i4_legacy_chunks": """WITH c AS (SELECT l_orderkey % 2000 AS segment, l_orderkey * 10 + l_linenumber AS pos, min(struct_pack(a := l_suppkey, b := l_quantity, c := l_returnflag)) AS r FROM lineitem GROUP BY ALL),
        t AS (SELECT segment, pos, r.a % 4 = 0 AS pause, r.b AS q, r.c AS f, sum(CASE WHEN r.a % 4 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY segment ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM c)
        SELECT segment, CAST(island AS BIGINT) AS island, pause, CASE WHEN pause THEN '' ELSE string_agg(f, ' ' ORDER BY pos) END AS syntagme, min(pos) AS begin_at, max(pos) AS end_at, round(sum(q), 2) AS duration FROM t GROUP BY segment, island, pause""",
    "j9_overlap_join": f"""WITH c AS (SELECT row_id, voice, segment, begin_syntagme_natural AS b, end_syntagme_natural AS e FROM bdd_syntagme_ssml WHERE {_SPOKEN} AND NOT isnan(begin_syntagme_natural) AND NOT isnan(end_syntagme_natural) AND begin_syntagme_natural >= 0 AND end_syntagme_natural > begin_syntagme_natural AND end_syntagme_natural < 600),
        g AS (SELECT voice, segment, d, CAST(unnest(range(0, CAST(floor(d) AS BIGINT), 2)) AS INTEGER) AS w_start FROM (SELECT voice, segment, max(e) AS d FROM c GROUP BY ALL))
        SELECT row_id, voice, segment, w_start FROM c JOIN g USING (voice, segment) WHERE b < least(w_start + 2.0, d) AND e > w_start""",
    "j11_asof_join": f"""WITH {IV} SELECT l.voice, l.segment, l.idx, coalesce(r.label, 'unknown') AS label FROM (SELECT * FROM iv WHERE mark <> '') l
        ASOF LEFT JOIN (SELECT voice, segment, xmin, CAST(idx AS VARCHAR) AS label FROM iv WHERE mark = '') r ON l.voice = r.voice AND l.segment = r.segment AND l.xmin >= r.xmin""",
    "a10_even_spans": r"""WITH w AS (SELECT row_id, CASE WHEN seg_no % 3 <> 0 AND seg_no > 0 THEN CAST(seg_no AS DOUBLE) ELSE 3.0 END AS d, list_filter(regexp_split_to_array(syntagme, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM bdd_ssml WHERE syntagme IS NOT NULL)
        SELECT row_id, CAST(i - 1 AS INTEGER) AS i, ws[i] AS word, round((i - 1) * d / len(ws), 4) AS xmin, round(i * d / len(ws), 4) AS xmax FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM w)""",
    "a6_repair_overlaps": f"""WITH RECURSIVE {IV}, n AS (SELECT voice, segment, xmin, mark, CASE WHEN idx % 3 = 0 THEN xmin ELSE xmax + 1000 END AS e, row_number() OVER (PARTITION BY voice, segment ORDER BY xmin, CASE WHEN idx % 3 = 0 THEN xmin ELSE xmax + 1000 END, mark) AS k FROM iv),
        r AS (SELECT voice, segment, k, greatest(xmin, 0.0) AS b, CASE WHEN e <= greatest(xmin, 0.0) THEN greatest(xmin, 0.0) + 0.01 ELSE e END AS e, mark FROM n WHERE k = 1
          UNION ALL SELECT n.voice, n.segment, n.k, greatest(n.xmin, r.e), CASE WHEN n.e <= greatest(n.xmin, r.e) THEN greatest(n.xmin, r.e) + 0.01 ELSE n.e END, n.mark FROM r JOIN n ON n.voice = r.voice AND n.segment = r.segment AND n.k = r.k + 1)
        SELECT voice, segment, CAST(k - 1 AS INTEGER) AS i, round(b, 3) AS xmin, round(e, 3) AS xmax, mark FROM r""",
    "i12_gap_sessions": f"""WITH RECURSIVE {IV}, n AS (SELECT voice, xmin AS b, xmin + 600 AS e, row_number() OVER (PARTITION BY voice ORDER BY xmin, xmin + 600) AS k FROM iv),
        r AS (SELECT voice, k, b, e, 1 AS s FROM n WHERE k = 1 UNION ALL
          SELECT n.voice, n.k, CASE WHEN n.b - r.e > 20000 OR r.e - r.b > 90000 THEN n.b ELSE r.b END, n.e, CASE WHEN n.b - r.e > 20000 OR r.e - r.b > 90000 THEN r.s + 1 ELSE r.s END FROM r JOIN n ON n.voice = r.voice AND n.k = r.k + 1)
        SELECT voice, round(min(b), 4) AS s_start, round(max(e), 4) AS s_end FROM r GROUP BY voice, s""",
    "w3_exponential_average": _STEP("0.2 * n.value + 0.8 * r.s") + " SELECT voice, pos, round(s, 4) AS smooth FROM r",
    "w4_limit_steps": _STEP("CASE WHEN abs(n.value - r.s) > 8 THEN r.s + sign(n.value - r.s) * 8 ELSE n.value END") + " SELECT voice, pos, round(s, 4) AS limited FROM r",
    "i20_break_labels": r"""WITH s AS (SELECT record_id, list_filter(parsed_sequence, lambda e: e IS NOT NULL) AS s FROM corpus), e AS (SELECT record_id, i, s[i] AS e, s[i + 1] AS nx FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM s)),
        w AS (SELECT record_id, CAST(i - 1 AS INTEGER) AS i, lower(trim(nx.type)) AS nt, list_filter(regexp_split_to_array(trim(e.text), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM e WHERE lower(trim(e.type)) = 'text')
        SELECT record_id, i, CAST(k - 1 AS INTEGER) AS k, ws[k] AS word, CASE WHEN k = len(ws) AND nt = 'break' THEN 1 ELSE 0 END AS label FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS k FROM w)""",
    "i3_segment_ids": f"WITH {IV} SELECT idx, voice || '_' || segment || '_segment_' || row_number() OVER (PARTITION BY voice, segment ORDER BY idx) AS phrase_id, round(xmax - xmin, 4) AS duration FROM iv",
    "j14_best_words": r"""WITH c AS (SELECT pred_id, string_split(lower(input_text), ' ') AS a, regexp_split_to_array(lower(trim(regexp_replace(gold_ssml, '<[^>]+>', ' ', 'g'))), ' +') AS b FROM predictions WHERE input_text IS NOT NULL AND gold_ssml IS NOT NULL),
        s AS (SELECT pred_id, i - 1 AS i, a[i] AS w FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM c)), n AS (SELECT pred_id, j - 1 AS j, b[j] AS w FROM (SELECT *, unnest(range(1, len(b) + 1)) AS j FROM c)),
        p AS (SELECT pred_id, i, j, s.w = n.w AS x, CASE WHEN s.w = n.w THEN 1.0 WHEN contains(n.w, s.w) OR contains(s.w, n.w) THEN least(length(s.w), length(n.w)) / nullif(greatest(length(s.w), length(n.w)), 0) END AS sc FROM s JOIN n USING (pred_id))
        SELECT pred_id, CAST(i AS INTEGER) AS synth_no, CAST(j AS INTEGER) AS natural_no FROM (SELECT *, row_number() OVER (PARTITION BY pred_id, i ORDER BY x DESC, sc DESC, j) AS r FROM p WHERE sc > 0) WHERE r = 1""",
    "g19_g20_interval_errors": f"""WITH c AS (SELECT voice, CAST(regexp_extract(segment, '([0-9]+)$', 1) AS INTEGER) AS no, CASE WHEN NOT isnan(begin_syntagme_natural) AND begin_syntagme_natural >= 0 AND begin_syntagme_natural < 600 THEN begin_syntagme_natural END AS gb, CASE WHEN NOT isnan(end_syntagme_natural) AND end_syntagme_natural >= 0 AND end_syntagme_natural < 600 THEN end_syntagme_natural END AS ge,
          CASE WHEN NOT isnan(begin_syntagme_synthesized) AND begin_syntagme_synthesized >= 0 AND begin_syntagme_synthesized < 600 THEN begin_syntagme_synthesized END AS pb, CASE WHEN NOT isnan(end_syntagme_synthesized) AND end_syntagme_synthesized >= 0 AND end_syntagme_synthesized < 600 THEN end_syntagme_synthesized END AS pe FROM bdd_syntagme_ssml WHERE {_SPOKEN}),
        k AS (SELECT voice, 'entire' AS level, 0 AS part, *, gb + ge + pb + pe IS NOT NULL AS ok FROM c UNION ALL SELECT voice, 'window', CAST(floor(no / 15) AS BIGINT), *, gb + ge + pb + pe IS NOT NULL FROM c)
        SELECT voice, level, CAST(part AS BIGINT) AS part, round(avg(CASE WHEN ok THEN 1 ELSE 0 END), 4) AS arr, round(avg(abs(gb - pb)) FILTER (ok), 4) AS mae_start, round(sqrt(avg((gb - pb) ** 2) FILTER (ok)), 4) AS rmse_start, round(avg(abs(ge - pe)) FILTER (ok), 4) AS mae_end, round(sqrt(avg((ge - pe) ** 2) FILTER (ok)), 4) AS rmse_end,
          round(avg(abs(ge - gb - (pe - pb))) FILTER (ok), 4) AS mae_dur, round(sqrt(avg((ge - gb - (pe - pb)) ** 2) FILTER (ok)), 4) AS rmse_dur FROM k GROUP BY voice, level, part""",
}
