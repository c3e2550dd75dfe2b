"""Queries of the file formats: what is written is read back, on columns, over whole tables; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import readers, writers
from .reference_intervals import IV, KEYS, events_as_intervals
from .tables import table


def k3_s4_textgrid(spark, folder):
    """Intervals to TextGrid texts and back."""
    iv = events_as_intervals(spark, folder).withColumns({"xmin": F.floor(F.col("xmin") * 1000) / 1000, "xmax": F.floor(F.col("xmax") * 1000) / 1000, "mark": F.replace("mark", F.lit("."), F.lit('"'))})
    back = readers.intervals_of(writers.textgrid(iv, KEYS), "value", "WORDS")
    return back.select(*KEYS, "idx", F.round("xmin", 3).alias("xmin"), F.round("xmax", 3).alias("xmax"), "mark")


def s7_textgrid_text(spark, folder):
    iv = events_as_intervals(spark, folder)
    return writers.textgrid(iv, KEYS).select(*KEYS, F.md5(readers.textgrid_text(F.col("value"))).alias("text"))


def s5_s6_gold_intervals(spark, folder):
    g = readers.gold_intervals(events_as_intervals(spark, folder).withColumn("mark", F.upper("mark")), lower=True)
    return g.select(*KEYS, "idx", "mark", F.round("duration", 4).alias("duration"))


def s13_s16_lines(spark, folder):
    """Lexicon, boundary, span and CTM lines made of events and parsed."""
    e = table(spark, folder, "events").select("event_id", "user_id", "event_type", F.col("value").cast("string").alias("v"), F.col("event_id").cast("string").alias("id"))
    cat = lambda *x: F.concat(*[F.lit(c) if not hasattr(c, "alias") else c for c in x])
    c = F.col
    rows = e.select(
        "event_id", readers.lexicon_entry(cat(F.upper("event_type"), "  ", c("v"), " x")).alias("l"), readers.boundary_entry(cat(c("v"), "\t", c("v"), "\t", c("event_type"))).alias("b"),
        readers.span_entry(cat(c("id"), "-", c("id"), ": ", c("event_type"), " ")).alias("s"), readers.ctm_entry(cat("f", F.col("user_id").cast("string"), " 1 ", c("v"), " 0.25 ", c("event_type"), "<space> NA lex NA")).alias("t"),
    )
    return rows.select("event_id", "l.word", "l.phones", F.round("b.timestamp", 4).alias("timestamp"), "b.label", F.round("s.end", 4).alias("span_end"), "t.file", F.round("t.start", 4).alias("start"), F.col("t.word").alias("ctm_word"))


def s9_corpus_json(spark, folder):
    """Records as corpus JSON by voice, read back."""
    c = table(spark, folder, "corpus").where(F.col("voice").isNotNull())
    text = F.to_json(F.create_map("voice", F.struct("x", F.struct("parsed_sequence", "stripped_ssml").alias("y"))))
    back = c.select("record_id", readers.corpus_records(text).alias("m")).select("record_id", F.explode("m").alias("voice", "r"))
    return back.select("record_id", "voice", F.md5("r.x").alias("x"), F.size("r.y.parsed_sequence").alias("elements"))


def s12_result_names(spark, folder):
    p = table(spark, folder, "predictions")
    return p.select("pred_id", readers.result_name(F.concat("model", F.lit("_"), "mode")).alias("n")).select("pred_id", "n.*")


def s3_alignment_lines(spark, folder):
    p = table(spark, folder, "part").select("p_partkey", readers.alignment_pair(F.concat("p_name", F.lit("  || "), F.col("p_partkey").cast("string"))).alias("p"))
    return p.select("p_partkey", "p.*")


def k5_label_lines(spark, folder):
    iv = events_as_intervals(spark, folder)
    return iv.select("idx", writers.label_line(F.floor("xmin"), F.floor("xmax"), F.col("mark")).alias("line"))


def k4_k6_k10_manifests(spark, folder):
    """Numbered file names, merge order and the rows that have a partner."""
    s = table(spark, folder, "bdd_ssml").groupBy("voice", "segment").agg(F.min("seg_no").alias("no"))
    m = writers.merge_manifest(s.withColumn("file", writers.numbered_name(F.col("no"))), ["voice"], "file", "no")
    return writers.copy_manifest(m, table(spark, folder, "predictions"), ["voice"])


QUERIES = {f.__name__: f for f in (k3_s4_textgrid, s3_alignment_lines, s5_s6_gold_intervals, s7_textgrid_text, s9_corpus_json, s12_result_names, s13_s16_lines, k4_k6_k10_manifests, k5_label_lines)}

SQL = {
    "k3_s4_textgrid": f"WITH {IV} SELECT voice, segment, CAST(row_number() OVER (PARTITION BY voice, segment ORDER BY idx) - 1 AS INTEGER) AS idx, round(floor(xmin * 1000) / 1000, 3) AS xmin, round(floor(xmax * 1000) / 1000, 3) AS xmax, replace(mark, '.', '\"') AS mark FROM iv",
    "s7_textgrid_text": f"WITH {IV} SELECT voice, segment, md5(coalesce(string_agg(mark, ' ' ORDER BY idx) FILTER (mark <> ''), '')) AS text FROM iv GROUP BY voice, segment",
    "s5_s6_gold_intervals": f"WITH {IV} SELECT voice, segment, idx, mark, round(xmax - xmin, 4) AS duration FROM iv WHERE mark <> ''",
    "s13_s16_lines": """SELECT event_id, event_type AS word, CAST(value AS VARCHAR) || ' x' AS phones, round(value, 4) AS timestamp, event_type AS label, round(event_id + 0.005::DOUBLE, 4) AS span_end, 'f' || user_id AS file, round(value, 4) AS start, event_type || ' ' AS ctm_word FROM events""",
    "s9_corpus_json": "SELECT record_id, voice, md5(x) AS x, CAST(len(parsed_sequence) AS INTEGER) AS elements FROM corpus WHERE voice IS NOT NULL",
    "s12_result_names": "SELECT pred_id, model, mode FROM predictions",
    "s3_alignment_lines": "SELECT p_partkey, p_name AS synthesized, CAST(p_partkey AS VARCHAR) AS natural FROM part",
    "k5_label_lines": f"WITH {IV} SELECT idx, printf('%.6f', floor(xmin)) || chr(9) || printf('%.6f', floor(xmax)) || chr(9) || mark AS line FROM iv",
    "k4_k6_k10_manifests": "WITH s AS (SELECT voice, segment, min(seg_no) AS no FROM bdd_ssml GROUP BY ALL) SELECT voice, CAST(row_number() OVER (PARTITION BY voice ORDER BY no) - 1 AS INTEGER) AS place, lpad(CAST(no AS VARCHAR), 4, '0') || '.xml' AS file FROM s WHERE voice IN (SELECT voice FROM predictions WHERE voice IS NOT NULL)",
}
