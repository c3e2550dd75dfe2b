"""Queries of the prosody arithmetic, aggregations, windows, sampling and sets, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import metrics, prosody, text
from ..operators import corpus, intervals
from ..operators.periods import spoken
from ..operators.ranking import salted_join, sharded_row_number, windowed_in_blocks
from .tables import table


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def _measured(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks with usable measurements (others null)."""
    c = table(spark, folder, "bdd_syntagme_ssml")
    ok = lambda n, lo, hi: F.when((F.col(n) > lo) & (F.col(n) < hi), F.col(n))
    return c.select(
        "row_id", "voice", "segment", "syn_no", "nombre_de_mots", "syntagme", "natural_syntagme_audio_path", text.is_blank(F.col("syntagme")).alias("pause"),
        ok("natural_pitch_syntagme", 0, 1000).alias("pn"), ok("synthesized_pitch_syntagme", 0, 1000).alias("ps"), ok("duration_syntagme_natural", 0, 600).alias("dn"), ok("duration_syntagme_synthesized", 0, 600).alias("ds"),
        ok("natural_loudness", -200, 0).alias("ln"), ok("synthesized_loudness", -200, 0).alias("ls"), ok("rate_natural", 0, 5000).alias("rn"), ok("rate_synthesized", 0, 5000).alias("rs"),
    )


_OK = lambda n, lo, hi, a: f"CASE WHEN NOT isnan({n}) AND {n} > {lo} AND {n} < {hi} THEN {n} END AS {a}"
_MEASURED = f"""m AS (SELECT row_id, voice, segment, syn_no, nombre_de_mots, syntagme, natural_syntagme_audio_path, trim(coalesce(syntagme, '')) = '' AS pause, {_OK("natural_pitch_syntagme", 0, 1000, "pn")}, {_OK("synthesized_pitch_syntagme", 0, 1000, "ps")},
  {_OK("duration_syntagme_natural", 0, 600, "dn")}, {_OK("duration_syntagme_synthesized", 0, 600, "ds")}, {_OK("natural_loudness", -200, 0, "ln")}, {_OK("synthesized_loudness", -200, 0, "ls")}, {_OK("rate_natural", 0, 5000, "rn")}, {_OK("rate_synthesized", 0, 5000, "rs")} FROM bdd_syntagme_ssml)"""


def m1_m5_adjustments(spark, folder):
    """Pitch against the voice's median, volume, rate, ratio and speaking time of every chunk."""
    m = _measured(spark, folder)
    base = m.groupBy("voice").agg(metrics.exact_median(F.col("pn")).alias("base"), metrics.exact_median(F.col("ln")).alias("loud"))
    j = salted_join(m, base, "voice", F.col("row_id"))
    return j.select("row_id", r6(prosody.pitch_percent(F.col("pn"), F.col("base")), "pitch"), r6(prosody.volume_percent(F.col("loud"), F.col("ls")), "volume"), r6(prosody.rate_percent(F.col("nombre_de_mots"), F.col("dn"), F.col("ds")), "rate"), r6(prosody.rate_ratio(F.col("nombre_de_mots"), F.col("dn"), F.col("ds")), "ratio"), r6(prosody.speaking_seconds(F.col("dn"), F.lit(0.25)), "speaking"))


def m6_m10_legacy(spark, folder):
    m = _measured(spark, folder)
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return m.select("row_id", r6(prosody.pitch_difference_percent(z("pn"), z("ps"), F.col("pause")), "pitch"), r6(prosody.relative_pitch_percent(z("pn"), z("ps"), F.lit(180.0), F.lit(170.0)), "relative"), r6(prosody.loudness_percent(z("ln"), z("ls")), "loudness"), r6(prosody.words_per_minute(F.col("nombre_de_mots"), z("dn")), "wpm"), r6(prosody.rate_difference_percent(z("rn"), z("rs")), "rate"), r6(prosody.calibration_percent(z("dn"), z("ds")), "calibration"))


def m8_m11_arrays(spark, folder):
    """Level, voiced median, finite values and every 16th element of arrays (bound to embeddings)."""
    e = table(spark, folder, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    return e.select("vec_id", r6(prosody.rms_decibel(F.col("a")), "db"), r6(prosody.voiced_median(F.col("a")), "median"), F.size(F.filter(F.transform("a", prosody.finite), lambda x: x.isNotNull())).alias("finite"), F.size(prosody.every_kth(F.col("a"), 16)).alias("kept"), r6(F.aggregate(prosody.every_kth(F.col("a"), 16), F.lit(0.0), lambda s, x: s + x), "kept_sum"))


def m18_cosine(spark, folder):
    e = table(spark, folder, "embeddings").select("vec_id", "embedding")
    o = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(o, "vec_id").select("vec_id", r6(prosody.cosine(F.col("embedding"), F.col("other")), "similarity"))


def m17_m19_m20_percents(spark, folder):
    p = table(spark, folder, "predictions").select("pred_id", F.explode("params.segments").alias("s"))
    p = p.select("pred_id", text.percent(F.col("s.prosody.pitch")).alias("pitch"), text.milliseconds(F.col("s.break_after")).alias("ms"))
    return p.groupBy("pred_id").agg(r6(F.sum("pitch"), "pitch"), F.sum("ms").alias("ms"), r6(F.sqrt(F.greatest(F.avg(F.pow("pitch", F.lit(2))), F.lit(0.0))), "rms"), r6(F.avg(F.col("pitch") / 2 * 4.0 + 1.5), "raw"))


def g3_path_means(spark, folder):
    w = Window.partitionBy("natural_syntagme_audio_path")
    m = _measured(spark, folder)
    return m.select("row_id", r6(F.coalesce(F.avg("pn").over(w), F.lit(0.0)), "mean_pitch"))


def g4_first_active(spark, folder):
    """Mean pitch of the first 50 spoken chunks of each voice."""
    m = _measured(spark, folder).where("NOT pause")
    n = F.row_number().over(Window.partitionBy("voice").orderBy(F.regexp_extract("segment", r"(\d+)$", 1).cast("int"), "syn_no", "row_id"))
    return m.withColumn("n", n).where("n <= 50").groupBy("voice").agg(r6(F.avg("pn"), "mean_pitch"))


def g5_g8_quantiles(spark, folder):
    m = _measured(spark, folder)
    q = F.percentile("dn", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return m.groupBy("voice").agg(r6(metrics.exact_median(F.col("pn")), "median_pitch"), q.alias("q")).select("voice", "median_pitch", *[r6(F.col("q")[i], n) for i, n in enumerate(("q1", "q2", "q3"))])


def g6_g7_corpus_stats(spark, folder):
    m = _measured(spark, folder)
    return m.groupBy(text.speaker_of(F.col("voice")).alias("speaker")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("voice").alias("voices"), r6(F.avg("dn"), "mean"), r6(F.min("dn"), "least"), r6(F.max("dn"), "most"), r6(F.sum("dn"), "total"), F.sum(text.word_count(F.col("syntagme"))).alias("words"))


def g7_punctuation(spark, folder):
    d = table(spark, folder, "documents").where(F.col("text").isNotNull())
    return d.select(F.explode(F.regexp_extract_all("text", F.lit("[,.!?;:]"), F.lit(0))).alias("mark")).groupBy("mark").agg(F.count(F.lit(1)).alias("n"))


def g1_g2_joined(spark, folder):
    c = table(spark, folder, "bdd_syntagme_ssml").where(F.col("syntagme").isNotNull())
    g = c.groupBy("voice", "segment").agg(F.array_sort(F.collect_list(F.struct("syn_no", "row_id", "syntagme"))).alias("a"))
    return g.select("voice", "segment", F.md5(F.array_join(F.transform("a", lambda s: s["syntagme"]), " ")).alias("joined"))


def g9_break_summary(spark, folder):
    c = table(spark, folder, "bdd_syntagme_ssml").where(text.is_blank(F.col("syntagme")))
    d = F.round((F.col("duration_pause_syntagme_synthesized") - F.col("duration_pause_syntagme_natural")) * 1000).cast("bigint")
    ok = (F.col("duration_pause_syntagme_synthesized") >= 0) & (F.col("duration_pause_syntagme_natural") >= 0) & (F.col("duration_pause_syntagme_synthesized") < 600) & (F.col("duration_pause_syntagme_natural") < 600)
    return c.where(ok).select("voice", d.alias("d")).groupBy("voice").agg(F.count(F.lit(1)).alias("n"), F.sum((F.abs("d") <= 50).cast("int")).alias("within"), r6(F.avg(F.abs("d")), "mean_abs"))


def g10_g12_calibration(spark, folder):
    m = _measured(spark, folder)
    return m.groupBy("voice").agg(r6(F.avg("pn"), "mean"), r6(metrics.safe_std(F.col("pn")), "std"), r6(metrics.geometric_mean(F.col("pn")), "geometric"))


def g11_sequence_averages(spark, folder):
    e = table(spark, folder, "corpus").select("record_id", F.explode(corpus.canonical_sequence(F.col("parsed_sequence"))).alias("e"))
    pct = lambda k: F.when(F.col("e.type") == "text", text.percent(F.col(f"e.prosody.{k}")))
    ms = F.when(F.col("e.type") == "break", text.milliseconds(F.col("e.time")))
    z = lambda c, n: r6(F.coalesce(F.avg(c), F.lit(0.0)), n)
    return e.groupBy("record_id").agg(z(pct("pitch"), "pitch"), z(pct("rate"), "rate"), z(pct("volume"), "volume"), z(F.when(ms > 0, ms), "break_ms"))


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted and gold numbers of each tag of a prediction, by attribute."""
    from ..functions.ssml import attribute_values

    p = table(spark, folder, "predictions").where(F.col("predicted_ssml").isNotNull() & F.col("gold_ssml").isNotNull())
    out = None
    for a in ("pitch", "rate", "volume"):
        z = p.select("model", "mode", F.lit(a).alias("attribute"), F.explode(F.arrays_zip(attribute_values(F.col("gold_ssml"), a, "%").alias("t"), attribute_values(F.col("predicted_ssml"), a, "%").alias("p"))).alias("z"))
        part = z.select("model", "mode", "attribute", F.col("z.t").alias("t"), F.col("z.p").alias("p")).where(F.col("t").isNotNull() & F.col("p").isNotNull())
        out = part if out is None else out.unionByName(part)
    return out


def g13_g14_errors(spark, folder):
    t, p = F.col("t"), F.col("p")
    return _pairs(spark, folder).groupBy("model", "mode", "attribute").agg(F.count(F.lit(1)).alias("n"), r6(metrics.mae(t, p), "mae"), r6(metrics.mse(t, p), "mse"), r6(metrics.rmse(t, p), "rmse"), r6(metrics.r2(t, p), "r2"))


def g15_g16_presence(spark, folder):
    p = table(spark, folder, "predictions")
    has = lambda c: F.coalesce(F.contains(c, F.lit("<break")), F.lit(False))
    pred, ref = has("predicted_ssml"), has("gold_ssml")
    return p.groupBy("model").agg(*[F.round(c, 6).alias(n) for c, n in zip(metrics.presence_scores(pred, ref), ("precision", "recall", "f1"))], r6(F.avg((pred & ref).cast("int")), "mean_f1"), r6(F.avg(F.coalesce(text.tight_breaks(F.col("predicted_ssml")) == text.tight_breaks(F.col("gold_ssml")), F.lit(False)).cast("int")), "exact"))


def g17_g18_token_scores(spark, folder):
    """Class scores over labels without -100 (bound to orders: label o_orderkey % 2), and perplexity of losses."""
    o = table(spark, folder, "orders").select("o_orderpriority", F.when(F.col("o_orderkey") % 10 == 0, -100).otherwise((F.col("o_orderkey") % 2).cast("int")).alias("label"), (F.col("o_custkey") % 2).cast("int").alias("guess"), (F.col("o_totalprice") / 1e6).alias("loss"))
    s = metrics.presence_scores(F.col("guess") == 1, F.col("label") == 1)
    return o.where("label <> -100").groupBy("o_orderpriority").agg(*[F.round(c, 6).alias(n) for c, n in zip(s, ("precision", "recall", "f1"))], r6(metrics.perplexity(F.col("loss")), "perplexity"))


def g21_g22_summaries(spark, folder):
    s = g13_g14_errors(spark, folder)
    return s.groupBy("attribute").agg(*[r6(f(F.col("mae")), f"{n}_mae") for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("least", F.min), ("most", F.max))])


def g23_tag_counts(spark, folder):
    p = table(spark, folder, "predictions").where(F.col("gold_ssml").isNotNull())
    n = lambda t: F.regexp_count("gold_ssml", F.lit(t))
    return p.select("pred_id", n("<prosody").alias("prosody"), n("<break").alias("breaks"), r6(n("<[^/][^>]*>") / text.mark_count(F.regexp_replace("gold_ssml", "<[^>]+>", "")), "per_sentence"))


def g25_r15_words(spark, folder):
    """Distinct words of the held-out items with their number of items."""
    w = table(spark, folder, "heldout_items").select("item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("word"))
    return w.groupBy("word").agg(F.count_distinct("item_id").alias("items"))


def w1_w2_rolling_median(spark, folder):
    """Centred rolling median of 11 segments' pitch, the voice's median where it has at most 10 segments."""
    s = table(spark, folder, "bdd_ssml").groupBy("voice", "seg_no").agg(F.min(F.when((F.col("average_natural_pitch_per_sentence") > 0) & (F.col("average_natural_pitch_per_sentence") < 1000), F.col("average_natural_pitch_per_sentence"))).alias("p"))
    whole = s.groupBy("voice").agg(F.count(F.lit(1)).alias("n"), metrics.exact_median(F.col("p")).alias("whole"))
    s = windowed_in_blocks(s, ["voice"], F.floor(F.col("seg_no") / 1024), [F.col("seg_no")], 5, 5, lambda w: {"roll": F.percentile("p", F.lit(0.5)).over(w)})
    s = salted_join(s, whole, "voice", F.col("seg_no"))
    return s.select("voice", "seg_no", r6(F.coalesce(F.when(F.col("n") <= 10, F.col("whole")).otherwise(F.col("roll")), F.lit(1.0)), "base"))


def w5_sliding_windows(spark, folder):
    c = table(spark, folder, "bdd_ssml").groupBy("voice", "seg_no").agg(F.min("row_id").alias("row_id"))
    return corpus.sliding_windows(c, ["voice"], "seg_no", "row_id", 4).select("voice", "seg_no", F.array_join(F.transform("win", lambda x: x.cast("string")), ",").alias("win"))


def w6_z_scores(spark, folder):
    m = _measured(spark, folder).where(F.col("pn").isNotNull())
    w = Window.partitionBy("voice", "segment")
    return m.select("row_id", r6(F.try_divide(F.col("pn") - F.avg("pn").over(w), F.stddev_pop("pn").over(w)), "z"))


def w7_w9_rankings(spark, folder):
    """Models by error of pitch, the best marked, and closeness of the two modes to a reference value."""
    s = g13_g14_errors(spark, folder).where("attribute = 'pitch'").select("model", "mode", "mae", "rmse")
    every = Window.partitionBy(F.lit(1))
    return s.select("model", "mode", "mae", F.row_number().over(every.orderBy("mae", "model", "mode")).alias("place"), (F.abs(F.col("rmse") - F.min("rmse").over(every)) < 1e-6).alias("best"), r6(F.min(F.abs(F.col("mae") - 5.0)).over(Window.partitionBy("model")), "closest"))


def w10_anonymous_ids(spark, folder):
    p = table(spark, folder, "predictions").groupBy("voice").agg(F.min("pred_id").alias("first_id"))
    placed = sharded_row_number(p, [], F.floor(F.col("first_id") / 65536), [F.col("first_id")], "n")
    return placed.select("voice", (F.col("n") + 1).cast("int").alias("speaker_no"))


def o1_numeric_order(spark, folder):
    s = table(spark, folder, "bdd_ssml").groupBy("voice", "segment").agg(F.min("row_id").alias("row_id"))
    no = text.sortable_number(F.col("segment"))
    return sharded_row_number(s, ["voice"], F.floor(no / 65536), [no], "n").select("voice", "segment", (F.col("n") + 1).cast("int").alias("place"))


def o2_split_sizes(spark, folder):
    s = corpus.shuffled_split(table(spark, folder, "corpus").select("record_id"), "record_id", {"train": 0.8, "val": 0.1, "test": 0.1})
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("record_id").alias("ids"))


def o3_sequential_split(spark, folder):
    return corpus.sequential_split(table(spark, folder, "predictions").select("pred_id"), "pred_id", {"train": 0.8, "val": 0.1, "test": 0.1}, F.floor(F.col("pred_id") / 1024))


def o4_episode_split(spark, folder):
    v = corpus.shuffled_split(table(spark, folder, "bdd_ssml").select("voice").distinct(), "voice", {"train": 0.75, "test": 0.25})
    j = table(spark, folder, "bdd_ssml").select("voice", "row_id").join(v, "voice")
    return j.groupBy("voice").agg(F.count_distinct("split").alias("splits"), F.count(F.lit(1)).alias("n"))


def o6_hash_sample(spark, folder):
    """10 rows by hash; their number and that all are rows of the table."""
    s = corpus.checked_sample(table(spark, folder, "predictions").select("pred_id"), "pred_id", 10)
    return s.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pred_id").alias("ids"))


def o7_bootstrap(spark, folder):
    b = corpus.bootstrap(table(spark, folder, "predictions").select("pred_id"), "pred_id", 10)
    return b.groupBy("run").agg(F.count(F.lit(1)).alias("n"))


def j1_j6_set_joins(spark, folder):
    """Segments on both sides, on one side only, and lexicon words missing from it."""
    a = table(spark, folder, "bdd_ssml").select("voice", "segment").distinct()
    b = table(spark, folder, "corpus").select("voice", F.explode("parsed_sequence.segment").alias("segment")).where(F.col("segment").isNotNull() & F.col("voice").isNotNull()).distinct()
    both, left, right = a.join(b, ["voice", "segment"], "left_semi"), a.join(b, ["voice", "segment"], "left_anti"), b.join(a, ["voice", "segment"], "left_anti")
    return both.withColumn("side", F.lit("both")).unionByName(left.withColumn("side", F.lit("left"))).unionByName(right.withColumn("side", F.lit("right")))


def j6_missing_words(spark, folder):
    words = lambda t, c: table(spark, folder, t).select(F.explode(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("word")).distinct()
    return words("heldout_items", "text").join(words("bdd_ssml", "syntagme"), "word", "left_anti")


def j4_p14_paired_features(spark, folder):
    """Natural and synthetic features by (voice, segment), pairs with a missing side dropped; missing texts as '...'."""
    m = _measured(spark, folder)
    n = m.where("pn IS NOT NULL").groupBy("voice", "segment").agg(F.avg("pn").alias("n"))
    s = m.where("ps IS NOT NULL").groupBy("voice", "segment").agg(F.avg("ps").alias("s"))
    t = table(spark, folder, "bdd_ssml").groupBy("voice", "segment").agg(F.max(F.when(~text.is_blank(F.col("syntagme")), F.col("syntagme"))).alias("t"))
    return n.join(s, ["voice", "segment"]).join(t, ["voice", "segment"], "left").select("voice", "segment", r6(F.col("n"), "natural"), r6(F.col("s"), "synthetic"), F.md5(F.coalesce("t", F.lit("..."))).alias("text"))


def j5_placeholders(spark, folder):
    """Segments missing on either side get a placeholder interval."""
    a = table(spark, folder, "bdd_ssml").where("seg_no % 3 <> 0").groupBy("voice", "segment").agg(F.max("syntagme").alias("a"))
    b = table(spark, folder, "bdd_syntagme_ssml").where("syn_no % 2 = 0").groupBy("voice", "segment").agg(F.max("syn_no").alias("b"))
    return a.join(b, ["voice", "segment"], "full_outer").select("voice", "segment", F.md5(F.coalesce("a", F.lit("..."))).alias("mark"), F.coalesce("b", F.lit(0)).alias("until"))


def j7_top_up(spark, folder):
    """Examples for prompts of up to 40, where nine records in ten are for evaluation."""
    c = table(spark, folder, "corpus").select("record_id", F.md5(F.coalesce("x", F.lit(chr(1)))).alias("content"))
    return corpus.example_pool(c, c.where("record_id % 10 <> 0"), "record_id", "content", 40)


def j12_j13_lookups(spark, folder):
    """Gold by voice and segment with a second episode as fallback; the last sample of equal texts."""
    p = table(spark, folder, "predictions").where(F.col("input_text").isNotNull()).select("pred_id", "voice", "input_text")
    last = p.groupBy("input_text").agg(F.max("pred_id").alias("last_id"))
    gold = table(spark, folder, "bdd_ssml").groupBy("voice").agg(F.min("ssml").alias("g"))
    other = gold.select(F.col("voice").alias("v2"), F.col("g").alias("g2"))
    j = p.join(last, "input_text").join(gold, "voice", "left").join(other, F.regexp_replace("voice", "_EP01$", "_EP02") == F.col("v2"), "left")
    return j.select("pred_id", "last_id", F.md5(F.coalesce("g", "g2", "input_text")).alias("gold"))


def u1_u5_sets(spark, folder):
    a, b = (table(spark, folder, t).select("voice").where(F.col("voice").isNotNull()) for t in ("corpus", "training_raw"))
    tag = lambda df, n: df.withColumn("op", F.lit(n))
    first = table(spark, folder, "corpus").where(F.col("voice").isNotNull()).groupBy("voice").agg(F.min("record_id")).select("voice")
    out = tag(a.intersect(b), "both")
    for df, n in ((a.subtract(b), "left"), (b.subtract(a), "right"), (a.union(b).distinct(), "distinct"), (first, "first")):
        out = out.unionByName(tag(df, n))
    return out.unionByName(tag(a.unionByName(b), "bag"))


def p12_p13_gates(spark, folder):
    """Noise gate on arrays (bound to embeddings), and placeholder for short transcripts."""
    e = table(spark, folder, "embeddings").select("vec_id", "embedding")
    quiet = F.size(F.filter("embedding", lambda x: F.abs(x) <= 0.05)) / F.size("embedding")
    rms = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x) / F.size("embedding"))
    return e.select("vec_id", ((quiet > 0.95) | (rms < 0.1)).alias("noise"), r6(quiet, "quiet"))


def p13_placeholders(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    return d.select("doc_id", F.md5(F.when((text.word_count(F.col("t")) < 3) | (F.length(F.trim("t")) < 10), "...").otherwise(F.col("t"))).alias("kept"))


def p17_o8_first_rows(spark, folder):
    """The first 50 chunks of each voice in order (the clip of a plot)."""
    m = _measured(spark, folder)
    w = Window.partitionBy("voice").orderBy(text.sortable_number(F.col("segment")), "syn_no", "row_id")
    return m.withColumn("n", F.row_number().over(w)).where("n <= 50").select("voice", "n", "row_id")


def r1_r9_r10_arrays(spark, folder):
    """Phrase breaks without the last, masked prompt labels, first-subtoken labels (bound to break times and embeddings)."""
    p = table(spark, folder, "predictions").select("pred_id", F.coalesce("metrics.break_times", F.array().cast("array<int>")).alias("b"))
    cut = F.when(F.size("b") >= 2, F.slice("b", F.lit(1), F.size("b") - 1)).otherwise(F.array().cast("array<int>"))
    masked = F.transform("b", lambda x, i: F.when(i < 2, -100).otherwise(x))
    first = F.transform("b", lambda x, i: F.when((i > 0) & (F.floor(F.get("b", i - 1) / 500) == F.floor(x / 500)), -100).otherwise(x))
    s = lambda a: F.array_join(F.transform(a, lambda x: F.coalesce(x.cast("string"), F.lit("null"))), ",")
    return p.select("pred_id", s(cut).alias("breaks"), s(masked).alias("masked"), s(first).alias("first"))


def r2_alignment_lines(spark, folder):
    c = table(spark, folder, "bdd_syntagme_ssml").where(spoken(F.col("syntagme")))
    whole = lambda x: F.coalesce(F.round(F.when(~F.isnan(x) & (F.abs(x) < 1e6), F.col(x)) * 1000).cast("bigint").cast("string"), F.lit("0"))
    part = lambda k: F.concat(F.col("syn_no").cast("string"), F.lit(": "), "syntagme", F.lit(" ("), whole(f"begin_syntagme_{k}"), F.lit("-"), whole(f"end_syntagme_{k}"), F.lit(")"))
    return c.select("row_id", F.md5(F.concat(part("synthesized"), F.lit(" || "), part("natural"))).alias("line"))


def r6_r7_corpus_targets(spark, folder):
    """Percents of text elements and their z-scores by overall mean and deviation."""
    e = table(spark, folder, "corpus").select("record_id", F.posexplode(corpus.canonical_sequence(F.col("parsed_sequence"))).alias("i", "e")).where("e.type = 'text' AND trim(e.text) <> ''")
    e = e.select("record_id", "i", text.percent(F.col("e.prosody.pitch")).alias("pitch")).where(F.col("pitch").isNotNull())
    m, s = e.agg(F.avg("pitch"), metrics.safe_std(F.col("pitch"))).first()  # two numbers
    return e.select("record_id", "i", r6(F.col("pitch"), "pitch"), r6((F.col("pitch") - F.lit(m)) / F.lit(s), "z"))


def r16_r17_lexicon(spark, folder):
    """Word to sound table, the last of equal words; missing words appended."""
    d = table(spark, folder, "part").select(F.lower(F.split_part(F.col("p_name"), F.lit(" "), F.lit(1))).alias("word"), "p_partkey", F.col("p_name").alias("phon"))
    lex = d.groupBy("word").agg(F.max_by("phon", "p_partkey").alias("phon"))
    new = table(spark, folder, "nation").select(F.lower("n_name").alias("word")).distinct().join(lex, "word", "left_anti").withColumn("phon", F.col("word"))
    return lex.unionByName(new)


def r18_manifest(spark, folder):
    s = table(spark, folder, "bdd_ssml").groupBy("voice", "segment").agg(F.max("syntagme").alias("t"))
    return s.select("voice", "segment", F.md5(F.concat(F.lit('{"audio_filepath":"'), F.concat_ws("/", "voice", F.concat("segment", F.lit(".wav"))), F.lit('","text":"'), text.without_commas(F.coalesce("t", F.lit(""))), F.lit('"}'))).alias("line"))


def r19_status_counts(spark, folder):
    p = table(spark, folder, "predictions")
    return p.groupBy("model", "mode").agg(F.sum((F.col("predicted_ssml").isNotNull() & F.col("params").isNotNull()).cast("int")).alias("ok"), F.count(F.lit(1)).alias("total"))


def r12_pair_manifest(spark, folder):
    """Segments packed to about 20 seconds, with what is kept of the last one. No SQL: sequential packing."""
    d = table(spark, folder, "bdd_syntagme_ssml").where(F.col("end_syntagme_natural") < 600).groupBy("voice", text.sortable_number(F.col("segment")).alias("no")).agg(F.max("end_syntagme_natural").alias("s"))
    p = corpus.packed_segments(d, ["voice"], "no", "s", target=20.0, margin=4.0)
    return p.select("voice", "chunk_no", F.posexplode("segments").alias("pos", "seg_no"), F.size("segments").alias("n"), "keep_last_s").select("voice", "chunk_no", "pos", "seg_no", F.when(F.col("pos") == F.col("n") - 1, F.round("keep_last_s", 6)).alias("keep_s"))


def r4_r5_r14_lookups(spark, folder):
    """The file of a segment by exact name, else the first that contains it; the segment's marks in order."""
    s = table(spark, folder, "bdd_syntagme_ssml")
    files = s.where(F.col("synthesized_syntagme_audio_path").isNotNull()).groupBy("voice", "segment").agg(F.min("synthesized_syntagme_audio_path").alias("path"))
    exact = files.where(F.col("path").rlike("segment_ph[0-9]*[02468].wav"))
    marks = s.where(~text.is_blank(F.col("syntagme"))).groupBy("voice", "segment").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("syn_no", "row_id", F.trim("syntagme").alias("t")))), lambda r: r["t"]), " ").alias("said"))
    j = marks.join(exact.withColumnRenamed("path", "own"), ["voice", "segment"], "left").join(files, ["voice", "segment"], "left")
    return j.select("voice", "segment", F.coalesce("own", "path").alias("path"), F.md5("said").alias("said"))


def r8_few_shot_prompt(spark, folder):
    """No SQL: pretty JSON differs between engines."""
    p = table(spark, folder, "predictions").where(F.col("input_text").isNotNull() & F.col("params").isNotNull())
    return corpus.few_shot_prompt(p, "input_text", "params", "pred_id")


def r23_break_listing(spark, folder):
    e = table(spark, folder, "corpus").select("record_id", F.posexplode(corpus.canonical_sequence(F.col("parsed_sequence"))).alias("i", "e"))
    return e.where("e.type = 'break'").select("record_id", "i", F.col("e.time").alias("time"), text.milliseconds(F.col("e.time")).isNull().alias("odd"))


def a11_position_pairs(spark, folder):
    """Words of a text by position against their normalised forms, and whether they agree."""
    b = table(spark, folder, "bdd_ssml").where(spoken(F.col("syntagme"))).select("row_id", text.manifest_words(F.col("syntagme")).alias("w"))
    return b.select("row_id", F.posexplode("w").alias("i", "p")).select("row_id", "i", "p.word", (text.fold_word(F.col("p.original")) == F.regexp_replace("p.word", r"[^a-z0-9_]", "")).alias("agrees"))


QUERIES = {
    f.__name__: f
    for f in (
        m1_m5_adjustments, m6_m10_legacy, m8_m11_arrays, m17_m19_m20_percents, m18_cosine, g1_g2_joined, g3_path_means, g4_first_active, g5_g8_quantiles, g6_g7_corpus_stats, g7_punctuation, g9_break_summary, g10_g12_calibration,
        g11_sequence_averages, g13_g14_errors, g15_g16_presence, g17_g18_token_scores, g21_g22_summaries, g23_tag_counts, g25_r15_words, w1_w2_rolling_median, w5_sliding_windows, w6_z_scores, w7_w9_rankings, w10_anonymous_ids,
        o1_numeric_order, o2_split_sizes, o3_sequential_split, o4_episode_split, o6_hash_sample, o7_bootstrap, j1_j6_set_joins, j4_p14_paired_features, j5_placeholders, j6_missing_words, j7_top_up, j12_j13_lookups, u1_u5_sets,
        r1_r9_r10_arrays, r2_alignment_lines, r4_r5_r14_lookups, r8_few_shot_prompt, r23_break_listing, a11_position_pairs, r6_r7_corpus_targets, r12_pair_manifest, r16_r17_lexicon, r18_manifest, r19_status_counts,
    )
} | {"s_p12_noise_gate": p12_p13_gates, "s_p13_placeholders": p13_placeholders, "s_p17_first_rows": p17_o8_first_rows}

_CLIP = lambda x, lo, hi: f"CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, {lo}), {hi}) END"
_SEG = "CAST(regexp_extract(segment, '([0-9]+)$', 1) AS INTEGER)"
_WC = lambda x: f"CASE WHEN trim(coalesce({x}, '')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace({x}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), ' ')) END"
_WORDS = lambda x: f"unnest(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+'))"
_PV = lambda x: f"TRY_CAST(regexp_replace(trim({x}), '[ ]*%$', '') AS DOUBLE)"
_MS = lambda x: f"TRY_CAST(nullif(regexp_extract(trim({x}), '^([0-9]+)[ ]*(?:ms)?$', 1), '') AS INTEGER)"
_ELS = "els AS (SELECT record_id, CAST(i - 1 AS INTEGER) AS i, lower(trim(s[i].type)) AS type, s[i] AS e FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM (SELECT record_id, list_filter(parsed_sequence, lambda e: e IS NOT NULL) AS s FROM corpus)))"
_LIST = lambda x, a: f"list_transform(regexp_extract_all({x}, '{a}=\"([+-]?[0-9.]+)%\"', 1), lambda v: CAST(v AS DOUBLE))"
_PAIRS = "pr AS (" + " UNION ALL ".join(f"SELECT model, mode, '{a}' AS attribute, t[i] AS t, p[i] AS p FROM (SELECT *, unnest(range(1, least(len(t), len(p)) + 1)) AS i FROM (SELECT model, mode, {_LIST('gold_ssml', a)} AS t, {_LIST('predicted_ssml', a)} AS p FROM predictions WHERE predicted_ssml IS NOT NULL AND gold_ssml IS NOT NULL))" for a in ("pitch", "rate", "volume")) + ")"
_ERRORS = _PAIRS + """, er AS (SELECT model, mode, attribute, count(*) AS n, round(avg(abs(t - p)), 6) AS mae, round(avg((t - p) ** 2), 6) AS mse, round(sqrt(avg((t - p) ** 2)), 6) AS rmse,
  round(CASE WHEN count(*) >= 2 AND var_pop(t) > 0 THEN 1 - sum((t - p) ** 2) / (var_pop(t) * count(*)) END, 6) AS r2 FROM pr GROUP BY ALL)"""
_PRF = lambda p, r: f"""round(CASE WHEN sum(CASE WHEN {p} THEN 1 ELSE 0 END) > 0 THEN sum(CASE WHEN {p} AND {r} THEN 1 ELSE 0 END) / sum(CASE WHEN {p} THEN 1 ELSE 0 END) ELSE 0 END, 6) AS precision,
  round(CASE WHEN sum(CASE WHEN {r} THEN 1 ELSE 0 END) > 0 THEN sum(CASE WHEN {p} AND {r} THEN 1 ELSE 0 END) / sum(CASE WHEN {r} THEN 1 ELSE 0 END) ELSE 0 END, 6) AS recall,
  round(CASE WHEN sum(CASE WHEN {p} THEN 1 ELSE 0 END) + sum(CASE WHEN {r} THEN 1 ELSE 0 END) > 0 AND sum(CASE WHEN {p} AND {r} THEN 1 ELSE 0 END) > 0 THEN 2.0 * sum(CASE WHEN {p} AND {r} THEN 1 ELSE 0 END) / (sum(CASE WHEN {p} THEN 1 ELSE 0 END) + sum(CASE WHEN {r} THEN 1 ELSE 0 END)) ELSE 0 END, 6) AS f1"""  # noqa: E731
_S = lambda x: f"coalesce(array_to_string(list_transform({x}, lambda v: coalesce(CAST(v AS VARCHAR), 'null')), ','), '')"

SQL = {
    "m1_m5_adjustments": f"""WITH {_MEASURED}, b AS (SELECT voice, median(pn) AS base, median(ln) AS loud FROM m GROUP BY voice), j AS (SELECT m.*, base, loud, {_CLIP("12 * log2(pn / base)", "-1.3 * 0.7", "1.3")} AS st, (pow(10, (loud - ls) / 20) - 1) * 100 AS v, CASE WHEN nombre_de_mots > 0 THEN (ds / dn - 1) * 100 ELSE 0 END AS rp FROM m JOIN b ON m.voice IS NOT DISTINCT FROM b.voice),
        k AS (SELECT *, CASE WHEN rp < 0 THEN rp * CASE WHEN dn <= 1 THEN 1 ELSE pow(dn, 1.5) END ELSE rp / CASE WHEN dn <= 1 THEN 1 ELSE sqrt(dn) END END - CASE WHEN dn IS NULL THEN 0 ELSE greatest(0, dn - 1) END * 2 AS r FROM j)
        SELECT row_id, round(CASE WHEN pn > 0 AND base > 0 THEN (pow(2, st / 12) - 1) * 100 ELSE 0 END, 6) AS pitch, round({_CLIP("v", -10, 10)}, 6) AS volume, round(CASE WHEN r IS NOT NULL THEN least(greatest(r, CASE WHEN dn > 5 THEN -15 ELSE -10 END), CASE WHEN dn > 5 THEN 5 ELSE 10 END) END, 6) AS rate,
          round(CASE WHEN nombre_de_mots > 0 AND ds > 0 AND dn > 0 THEN ds / dn ELSE 1 END, 6) AS ratio, round(greatest(dn - 0.25, 1e-4), 6) AS speaking FROM k""",
    "m6_m10_legacy": f"""WITH {_MEASURED}, z AS (SELECT row_id, pause, nombre_de_mots AS w, coalesce(pn, 0) AS pn, coalesce(ps, 0) AS ps, coalesce(dn, 0) AS dn, coalesce(ds, 0) AS ds, coalesce(ln, 0) AS ln, coalesce(ls, 0) AS ls, coalesce(rn, 0) AS rn, coalesce(rs, 0) AS rs FROM m)
        SELECT row_id, round(CASE WHEN NOT pause AND ps <> 0 THEN {_CLIP("(pn - ps) / ps * 100", -100, 100)} ELSE 0 END, 6) AS pitch, round(CASE WHEN pn <> 0 AND ps <> 0 THEN ((ps / 170.0) / (pn / 180.0) - 1) * 100 ELSE 0 END, 6) AS relative, round(CASE WHEN ls <> 0 THEN {_CLIP("(ln - ls) / abs(ls) * 100", -20, 20)} ELSE 0 END, 6) AS loudness,
          round(CASE WHEN dn > 0 THEN w / (dn / 60) ELSE 0 END, 6) AS wpm, round(CASE WHEN rs <> 0 THEN {_CLIP("(rn - rs) / rs * 100", -100, 100)} ELSE 0 END, 6) AS rate, round(CASE WHEN ds > 0 THEN {_CLIP("(dn / ds - 1) * 100", -50, 100)} ELSE 0 END, 6) AS calibration FROM z""",
    "m8_m11_arrays": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings), v AS (SELECT *, list_filter(a, lambda x: x > 0) AS p, list_filter(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN (i - 1) % 16 = 0 THEN a[i] END), lambda x: x IS NOT NULL) AS k FROM e)
        SELECT vec_id, round(20 * log10(greatest(sqrt(list_sum(list_transform(a, lambda x: x * x)) / len(a)), 1e-6)), 6) AS db, round(coalesce(list_median(p), 0), 6) AS median, CAST(len(a) AS INTEGER) AS finite, CAST(len(k) AS INTEGER) AS kept, round(list_sum(k), 6) AS kept_sum FROM v""",
    "m18_cosine": "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "m17_m19_m20_percents": f"""WITH s AS (SELECT pred_id, unnest(params.segments) AS s FROM predictions), v AS (SELECT pred_id, {_PV("s.prosody.pitch")} AS p, {_MS("s.break_after")} AS ms FROM s)
        SELECT pred_id, round(sum(p), 6) AS pitch, CAST(sum(ms) AS BIGINT) AS ms, round(sqrt(greatest(avg(p * p), 0)), 6) AS rms, round(avg(p / 2 * 4 + 1.5), 6) AS raw FROM v GROUP BY pred_id""",
    "g1_g2_joined": "SELECT voice, segment, md5(string_agg(syntagme, ' ' ORDER BY syn_no, row_id)) AS joined FROM bdd_syntagme_ssml WHERE syntagme IS NOT NULL GROUP BY voice, segment",
    "g3_path_means": f"WITH {_MEASURED} SELECT row_id, round(coalesce(avg(pn) OVER (PARTITION BY natural_syntagme_audio_path), 0), 6) AS mean_pitch FROM m",
    "g4_first_active": f"WITH {_MEASURED} SELECT voice, round(avg(pn), 6) AS mean_pitch FROM (SELECT *, row_number() OVER (PARTITION BY voice ORDER BY {_SEG}, syn_no, row_id) AS n FROM m WHERE NOT pause) WHERE n <= 50 GROUP BY voice",
    "g5_g8_quantiles": f"WITH {_MEASURED} SELECT voice, round(median(pn), 6) AS median_pitch, round(quantile_cont(dn, 0.25), 6) AS q1, round(quantile_cont(dn, 0.5), 6) AS q2, round(quantile_cont(dn, 0.75), 6) AS q3 FROM m GROUP BY voice",
    "g6_g7_corpus_stats": f"""WITH {_MEASURED} SELECT CASE WHEN regexp_matches(voice, '^.+_EP[0-9]+$') THEN regexp_extract(voice, '^(.+)_EP[0-9]+$', 1) ELSE split_part(voice, '_', 1) END AS speaker, count(*) AS n, count(DISTINCT voice) AS voices, round(avg(dn), 6) AS mean, round(min(dn), 6) AS least, round(max(dn), 6) AS most, round(sum(dn), 6) AS total, CAST(sum({_WC("syntagme")}) AS BIGINT) AS words FROM m GROUP BY 1""",
    "g7_punctuation": "SELECT mark, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[,.!?;:]')) AS mark FROM documents WHERE text IS NOT NULL) GROUP BY mark",
    "g9_break_summary": """WITH d AS (SELECT voice, CAST(round((duration_pause_syntagme_synthesized - duration_pause_syntagme_natural) * 1000) AS BIGINT) AS d FROM bdd_syntagme_ssml WHERE trim(coalesce(syntagme, '')) = '' AND NOT isnan(duration_pause_syntagme_synthesized) AND NOT isnan(duration_pause_syntagme_natural)
          AND duration_pause_syntagme_synthesized >= 0 AND duration_pause_syntagme_natural >= 0 AND duration_pause_syntagme_synthesized < 600 AND duration_pause_syntagme_natural < 600)
        SELECT voice, count(*) AS n, CAST(sum(CASE WHEN abs(d) <= 50 THEN 1 ELSE 0 END) AS BIGINT) AS within, round(avg(abs(d)), 6) AS mean_abs FROM d GROUP BY voice""",
    "g10_g12_calibration": f"WITH {_MEASURED} SELECT voice, round(avg(pn), 6) AS mean, round(CASE WHEN stddev_pop(pn) = 0 THEN 1 ELSE stddev_pop(pn) END, 6) AS std, round(exp(avg(ln(pn))), 6) AS geometric FROM m GROUP BY voice",
    "g11_sequence_averages": f"""WITH {_ELS} SELECT record_id, {", ".join(f"round(coalesce(avg(CASE WHEN type = 'text' THEN {_PV(f'e.prosody.{k}')} END), 0), 6) AS {k}" for k in ("pitch", "rate", "volume"))}, round(coalesce(avg(CASE WHEN type = 'break' AND {_MS("e.time")} > 0 THEN {_MS("e.time")} END), 0), 6) AS break_ms FROM els GROUP BY record_id""",
    "g13_g14_errors": f"WITH {_ERRORS} SELECT * FROM er",
    "g15_g16_presence": f"""WITH p AS (SELECT model, coalesce(contains(predicted_ssml, '<break'), false) AS p, coalesce(contains(gold_ssml, '<break'), false) AS r, coalesce(trim(regexp_replace(predicted_ssml, '\\s*<break\\s*/>\\s*', '<break/>', 'g')) = trim(regexp_replace(gold_ssml, '\\s*<break\\s*/>\\s*', '<break/>', 'g')), false) AS x FROM predictions)
        SELECT model, {_PRF("p", "r")}, round(avg(CASE WHEN p AND r THEN 1 ELSE 0 END), 6) AS mean_f1, round(avg(CASE WHEN x THEN 1 ELSE 0 END), 6) AS exact FROM p GROUP BY model""",
    "g17_g18_token_scores": f"""SELECT o_orderpriority, {_PRF("o_custkey % 2 = 1", "o_orderkey % 2 = 1")}, round(exp(avg(o_totalprice / 1e6)), 6) AS perplexity FROM orders WHERE o_orderkey % 10 <> 0 GROUP BY o_orderpriority""",
    "g21_g22_summaries": f"WITH {_ERRORS} SELECT attribute, round(avg(mae), 6) AS mean_mae, round(stddev_pop(mae), 6) AS std_mae, round(min(mae), 6) AS least_mae, round(max(mae), 6) AS most_mae FROM er GROUP BY attribute",
    "g23_tag_counts": """SELECT pred_id, CAST(len(regexp_extract_all(gold_ssml, '<prosody')) AS INTEGER) AS prosody, CAST(len(regexp_extract_all(gold_ssml, '<break')) AS INTEGER) AS breaks, round(len(regexp_extract_all(gold_ssml, '<[^/][^>]*>')) / greatest(len(regexp_extract_all(regexp_replace(gold_ssml, '<[^>]+>', '', 'g'), '[.!?]')), 1), 6) AS per_sentence FROM predictions WHERE gold_ssml IS NOT NULL""",
    "g25_r15_words": f"SELECT word, count(DISTINCT item_id) AS items FROM (SELECT item_id, {_WORDS('text')} AS word FROM heldout_items) GROUP BY word",
    "w1_w2_rolling_median": """WITH s AS (SELECT voice, seg_no, min(CASE WHEN NOT isnan(average_natural_pitch_per_sentence) AND average_natural_pitch_per_sentence > 0 AND average_natural_pitch_per_sentence < 1000 THEN average_natural_pitch_per_sentence END) AS p FROM bdd_ssml GROUP BY voice, seg_no)
        SELECT voice, seg_no, round(coalesce(CASE WHEN count(*) OVER (PARTITION BY voice) <= 10 THEN median(p) OVER (PARTITION BY voice) ELSE median(p) OVER (PARTITION BY voice ORDER BY seg_no ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) END, 1), 6) AS base FROM s""",
    "w5_sliding_windows": """WITH c AS (SELECT voice, seg_no, min(row_id) AS row_id FROM bdd_ssml GROUP BY voice, seg_no), w AS (SELECT voice, seg_no, list(row_id) OVER (PARTITION BY voice ORDER BY seg_no ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS w FROM c) SELECT voice, seg_no, array_to_string(w, ',') AS win FROM w WHERE len(w) = 4""",
    "w6_z_scores": f"WITH {_MEASURED} SELECT row_id, round((pn - avg(pn) OVER w) / nullif(stddev_pop(pn) OVER w, 0), 6) AS z FROM m WHERE pn IS NOT NULL WINDOW w AS (PARTITION BY voice, segment)",
    "w7_w9_rankings": f"WITH {_ERRORS} SELECT model, mode, mae, CAST(row_number() OVER (ORDER BY mae, model, mode) AS INTEGER) AS place, abs(rmse - min(rmse) OVER ()) < 1e-6 AS best, round(min(abs(mae - 5)) OVER (PARTITION BY model), 6) AS closest FROM er WHERE attribute = 'pitch'",
    "w10_anonymous_ids": "SELECT voice, CAST(dense_rank() OVER (ORDER BY f) AS INTEGER) AS speaker_no FROM (SELECT voice, min(pred_id) AS f FROM predictions GROUP BY voice)",
    "o1_numeric_order": f"SELECT voice, segment, CAST(row_number() OVER (PARTITION BY voice ORDER BY {_SEG}) AS INTEGER) AS place FROM (SELECT DISTINCT voice, segment FROM bdd_ssml)",
    "o2_split_sizes": "WITH n AS (SELECT count(*) AS n FROM corpus) SELECT s.split, n, n AS ids FROM (SELECT 'train' AS split, CAST(floor(n * 0.8) AS BIGINT) AS n FROM n UNION ALL SELECT 'val', CAST(floor(n * 0.1) AS BIGINT) FROM n UNION ALL SELECT 'test', n - CAST(floor(n * 0.8) AS BIGINT) - CAST(floor(n * 0.1) AS BIGINT) FROM n) s",
    "o3_sequential_split": "WITH p AS (SELECT pred_id, row_number() OVER (ORDER BY pred_id) - 1 AS k, count(*) OVER () AS n FROM predictions) SELECT pred_id, CASE WHEN k < floor(n * 0.8) THEN 'train' WHEN k < floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM p",
    "o4_episode_split": "SELECT voice, CAST(1 AS BIGINT) AS splits, count(*) AS n FROM bdd_ssml WHERE voice IS NOT NULL GROUP BY voice",
    "o6_hash_sample": "SELECT CAST(10 AS BIGINT) AS n, CAST(10 AS BIGINT) AS ids",
    "o7_bootstrap": "SELECT CAST(r AS INTEGER) AS run, count(*) AS n FROM predictions, range(10) t(r) GROUP BY r",
    "j1_j6_set_joins": """WITH a AS (SELECT DISTINCT voice, segment FROM bdd_ssml), b AS (SELECT DISTINCT voice, segment FROM (SELECT voice, unnest(parsed_sequence).segment AS segment FROM corpus) WHERE segment IS NOT NULL AND voice IS NOT NULL)
        SELECT a.*, 'both' AS side FROM a SEMI JOIN b USING (voice, segment) UNION ALL SELECT a.*, 'left' FROM a ANTI JOIN b USING (voice, segment) UNION ALL SELECT b.*, 'right' FROM b ANTI JOIN a USING (voice, segment)""",
    "j4_p14_paired_features": f"""WITH {_MEASURED}, n AS (SELECT voice, segment, avg(pn) AS n FROM m WHERE pn IS NOT NULL GROUP BY ALL), s AS (SELECT voice, segment, avg(ps) AS s FROM m WHERE ps IS NOT NULL GROUP BY ALL), t AS (SELECT voice, segment, max(CASE WHEN trim(coalesce(syntagme, '')) <> '' THEN syntagme END) AS t FROM bdd_ssml GROUP BY ALL)
        SELECT n.voice, n.segment, round(n, 6) AS natural, round(s, 6) AS synthetic, md5(coalesce(t, '...')) AS text FROM n JOIN s USING (voice, segment) LEFT JOIN t USING (voice, segment)""",
    "j5_placeholders": """WITH a AS (SELECT voice, segment, max(syntagme) AS a FROM bdd_ssml WHERE seg_no % 3 <> 0 GROUP BY ALL), b AS (SELECT voice, segment, max(syn_no) AS b FROM bdd_syntagme_ssml WHERE syn_no % 2 = 0 GROUP BY ALL)
        SELECT voice, segment, md5(coalesce(a, '...')) AS mark, coalesce(b, 0) AS until FROM a FULL JOIN b USING (voice, segment)""",
    "j6_missing_words": f"SELECT DISTINCT word FROM (SELECT {_WORDS('text')} AS word FROM heldout_items) WHERE word NOT IN (SELECT {_WORDS('syntagme')} FROM bdd_ssml)",
    "j7_top_up": """WITH c AS (SELECT record_id, md5(coalesce(x, chr(1))) AS h FROM corpus), e AS (SELECT * FROM c WHERE record_id % 10 <> 0), r AS (SELECT record_id FROM c WHERE h NOT IN (SELECT h FROM e))
        SELECT record_id, false AS topped_up FROM r
        UNION ALL SELECT record_id, true FROM (SELECT record_id, row_number() OVER (ORDER BY md5(CAST(record_id AS VARCHAR) || ':42'), record_id) AS k FROM e) WHERE k <= 40 - (SELECT count(*) FROM r)""",
    "j12_j13_lookups": """WITH p AS (SELECT pred_id, voice, input_text, max(pred_id) OVER (PARTITION BY input_text) AS last_id FROM predictions WHERE input_text IS NOT NULL AND voice IS NOT NULL), g AS (SELECT voice, min(ssml) AS g FROM bdd_ssml GROUP BY voice)
        SELECT pred_id, last_id, md5(coalesce(a.g, b.g, input_text)) AS gold FROM p LEFT JOIN g a ON a.voice = p.voice LEFT JOIN g b ON b.voice = regexp_replace(p.voice, '_EP01$', '_EP02')""",
    "u1_u5_sets": """WITH a AS (SELECT voice FROM corpus WHERE voice IS NOT NULL), b AS (SELECT voice FROM training_raw WHERE voice IS NOT NULL) SELECT *, 'both' AS op FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT *, 'left' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
        UNION ALL SELECT *, 'distinct' FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT *, 'first' FROM (SELECT DISTINCT voice FROM a) UNION ALL SELECT *, 'bag' FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""",
    "s_p12_noise_gate": """WITH e AS (SELECT vec_id, len(list_filter(embedding, lambda x: abs(x) <= 0.05)) / len(embedding) AS q, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) / len(embedding)) AS r FROM embeddings) SELECT vec_id, q > 0.95 OR r < 0.1 AS noise, round(q, 6) AS quiet FROM e""",
    "s_p13_placeholders": f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents) SELECT doc_id, md5(CASE WHEN {_WC('t')} < 3 OR length(trim(t)) < 10 THEN '...' ELSE t END) AS kept FROM d",
    "s_p17_first_rows": f"WITH {_MEASURED} SELECT voice, CAST(n AS INTEGER) AS n, row_id FROM (SELECT *, row_number() OVER (PARTITION BY voice ORDER BY {_SEG}, syn_no, row_id) AS n FROM m) WHERE n <= 50",
    "r1_r9_r10_arrays": f"""WITH p AS (SELECT pred_id, coalesce(metrics.break_times, []) AS b FROM predictions) SELECT pred_id, {_S("CASE WHEN len(b) >= 2 THEN b[1:len(b) - 1] ELSE [] END")} AS breaks, {_S("list_transform(range(1, len(b) + 1), lambda i: CASE WHEN i <= 2 THEN -100 ELSE b[i] END)")} AS masked,
        {_S("list_transform(range(1, len(b) + 1), lambda i: CASE WHEN i > 1 AND floor(b[i - 1] / 500) = floor(b[i] / 500) THEN -100 ELSE b[i] END)")} AS first FROM p""",
    "r2_alignment_lines": "WITH c AS (SELECT row_id, syn_no, syntagme, " + ", ".join(f"coalesce(CAST(CAST(round(CASE WHEN NOT isnan({a}_syntagme_{k}) AND abs({a}_syntagme_{k}) < 1e6 THEN {a}_syntagme_{k} END * 1000) AS BIGINT) AS VARCHAR), '0') AS {a[0]}{k[0]}" for a in ("begin", "end") for k in ("synthesized", "natural")) + r""" FROM bdd_syntagme_ssml WHERE regexp_matches(syntagme, '[^\s\x{85}\x{A0}\x{202F}\x{2009}\x{3000}]'))
        SELECT row_id, md5(syn_no || ': ' || syntagme || ' (' || bs || '-' || es || ') || ' || syn_no || ': ' || syntagme || ' (' || bn || '-' || en || ')') AS line FROM c""",
    "r4_r5_r14_lookups": """WITH f AS (SELECT voice, segment, min(synthesized_syntagme_audio_path) AS p FROM bdd_syntagme_ssml WHERE synthesized_syntagme_audio_path IS NOT NULL GROUP BY ALL),
        m AS (SELECT voice, segment, string_agg(trim(syntagme), ' ' ORDER BY syn_no, row_id) AS said FROM bdd_syntagme_ssml WHERE trim(coalesce(syntagme, '')) <> '' GROUP BY ALL)
        SELECT voice, segment, p AS path, md5(said) AS said FROM m LEFT JOIN f USING (voice, segment)""",
    "r23_break_listing": f"WITH {_ELS} SELECT record_id, i, e.time AS time, {_MS('e.time')} IS NULL AS odd FROM els WHERE type = 'break'",
    "a11_position_pairs": rf"""WITH w AS (SELECT row_id, list_filter(string_split(translate(translate(translate(trim(syntagme), '"', ''''), '.,;:!?()[]{{}}', ''), '-_', '  '), ' '), lambda w: w <> '') AS w FROM bdd_ssml WHERE regexp_matches(syntagme, '[^\s\x{{85}}\x{{A0}}\x{{202F}}\x{{2009}}\x{{3000}}]'))
        SELECT row_id, CAST(i - 1 AS INTEGER) AS i, translate(lower(w[i]), '{text.ACCENTS_WIDE[0]}', '{text.ACCENTS_WIDE[1]}') AS word,
          translate(regexp_replace(lower(w[i]), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '{text.ACCENTS[0]}', '{text.ACCENTS[1]}') = regexp_replace(translate(lower(w[i]), '{text.ACCENTS_WIDE[0]}', '{text.ACCENTS_WIDE[1]}'), '[^a-z0-9_]', '', 'g') AS agrees FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM w)""",
    "r6_r7_corpus_targets": f"""WITH {_ELS}, t AS (SELECT record_id, i, {_PV("e.prosody.pitch")} AS p FROM els WHERE type = 'text' AND trim(e.text) <> ''), v AS (SELECT * FROM t WHERE p IS NOT NULL)
        SELECT record_id, i, round(p, 6) AS pitch, round((p - avg(p) OVER ()) / CASE WHEN stddev_pop(p) OVER () = 0 THEN 1 ELSE stddev_pop(p) OVER () END, 6) AS z FROM v""",
    "r16_r17_lexicon": """WITH l AS (SELECT word, max_by(phon, p_partkey) AS phon FROM (SELECT lower(split_part(p_name, ' ', 1)) AS word, p_partkey, p_name AS phon FROM part) GROUP BY word) SELECT * FROM l UNION ALL SELECT DISTINCT lower(n_name), lower(n_name) FROM nation WHERE lower(n_name) NOT IN (SELECT word FROM l)""",
    "r18_manifest": """SELECT voice, segment, md5('{"audio_filepath":"' || concat_ws('/', voice, segment || '.wav') || '","text":"' || translate(coalesce(max(syntagme), ''), ',;', '') || '"}') AS line FROM bdd_ssml GROUP BY voice, segment""",
    "r19_status_counts": "SELECT model, mode, CAST(sum(CASE WHEN predicted_ssml IS NOT NULL AND params IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS ok, count(*) AS total FROM predictions GROUP BY model, mode",
}
