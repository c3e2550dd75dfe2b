"""Queries of the general data-preparation operators (p1, p3, p4, p5) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.impute import Categorical, Numeric, chained_impute
from ..operators.nested import object_store, unpack_columns, unpack_payloads
from ..operators.periods import mend_intervals, periods_and_gaps, spoken
from ..operators.ranking import null_safe_join
from ..operators.spikes import faulty_readings
from .tables import table


def p1_bridge(spark: SparkSession, folder: str) -> DataFrame:
    """Every occurrence of an object, list or value of the records under its parent; see nested.BRIDGE."""
    parts = [
        unpack_columns(table(spark, folder, "corpus"), "record_id", sequence="parsed_sequence", stripped="stripped_ssml").withColumn("src", F.lit("corpus")),
        unpack_columns(table(spark, folder, "predictions"), "pred_id", metrics="metrics").withColumn("src", F.lit("predictions")),
        unpack_payloads(table(spark, folder, "training_raw"), "raw_id", "payload").withColumn("src", F.lit("training_raw")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_bridge(spark, folder).where(F.col("child").isNotNull()).select("src", "record_id", "child", "segment", "pos")


def p1_objects(spark: SparkSession, folder: str) -> DataFrame:
    """Each distinct object, list and value once, with the number of its occurrences."""
    return object_store(p1_bridge(spark, folder))


CHUNK_FIELDS = [Numeric("duration_syntagme_natural", 0, 600), Numeric("duration_syntagme_synthesized", 0, 600)]
SEGMENT_FIELDS = [Numeric("average_natural_pitch_per_sentence", 0, 1000)]
VOICE_NAME = Categorical("azure_voice_name", "^fr-FR-.+Neural$")


def p3_filled(spark: SparkSession, folder: str) -> DataFrame:
    """table_name, row_id, field_name, number, category: the values put in place of missing ones."""
    chunks, segments = table(spark, folder, "bdd_syntagme_ssml"), table(spark, folder, "bdd_ssml")
    words = F.log1p(F.size(F.regexp_extract_all("syntagme", F.lit(r"[^\p{IsWhite_Space}]+"), F.lit(0))).cast("double"))
    one = chained_impute(chunks, "row_id", "voice", CHUNK_FIELDS, predictors={"chars": F.log1p(F.length("syntagme").cast("double")), "words": words}, where=spoken(F.col("syntagme")))
    p = F.col("average_synthesized_pitch_per_sentence")
    two = chained_impute(segments, "row_id", "voice", SEGMENT_FIELDS, [VOICE_NAME], predictors={"synthesized": F.when((p > 0) & (p < 1000), F.log(p))}, where=spoken(F.col("syntagme")))
    return one.withColumn("table_name", F.lit("bdd_syntagme_ssml")).unionByName(two.withColumn("table_name", F.lit("bdd_ssml"))).select("table_name", F.col("id").alias("row_id"), "field_name", "number", "category")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_filled(spark, folder).select("table_name", "row_id", "field_name")


PITCH = (0.0, 1000.0)
READINGS = {"natural_pitch_syntagme": PITCH, "synthesized_pitch_syntagme": PITCH, "rate_adjustment": (-100.0, 100.0)}


def p4_faults(spark: SparkSession, folder: str) -> DataFrame:
    """row_id, field_name, kind, radius of every delivery of a faulty reading."""
    rows = table(spark, folder, "bdd_syntagme_ssml").where(spoken(F.col("syntagme"))).withColumn("voice", F.coalesce("voice", F.lit("")))
    seg_no = F.expr("try_cast(regexp_extract(segment, '([0-9]+)$', 1) AS BIGINT)")
    order = [F.col("seg_no"), F.col("segment"), F.col("syn_no")]
    faults = faulty_readings(rows.withColumn("seg_no", F.coalesce(seg_no, F.lit(-1))), "voice", ["seg_no", "segment", "syn_no"], order, F.floor(F.col("seg_no") / 64), READINGS)
    return null_safe_join(rows.select("row_id", "voice", "segment", "syn_no"), faults.drop("seg_no"), ["voice", "segment", "syn_no"]).select("row_id", "field_name", "kind", "radius")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_faults(spark, folder).select("row_id", "field_name")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "bdd_syntagme_ssml").where(spoken(F.col("syntagme")))
    times = mend_intervals(rows, "begin_syntagme_natural", "end_syntagme_natural", "duration_syntagme_natural")
    return periods_and_gaps(times, ["voice", "segment"])


QUERIES = {f.__name__: f for f in (p1_found, p1_bridge, p1_objects, p3_found, p3_filled, p4_found, p4_faults, p5_found)}

_WS = r"[^\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_MS = lambda c: f"CAST(round({c} * 1000) AS BIGINT)"
_NUM = lambda c: f"CASE WHEN NOT isnan({c}) THEN {c} END"

SQL = {
    "p3_found": f"""
        SELECT 'bdd_syntagme_ssml' AS table_name, row_id, field_name FROM (
          SELECT row_id, unnest(['duration_syntagme_natural', 'duration_syntagme_synthesized']) AS field_name,
                 unnest([duration_syntagme_natural, duration_syntagme_synthesized]) AS v
          FROM bdd_syntagme_ssml WHERE regexp_matches(syntagme, '{_WS}'))
        WHERE NOT coalesce(v > 0 AND v < 600 AND NOT isnan(v), false)
        UNION ALL
        SELECT 'bdd_ssml', row_id, 'average_natural_pitch_per_sentence' FROM bdd_ssml
        WHERE regexp_matches(syntagme, '{_WS}') AND NOT coalesce(average_natural_pitch_per_sentence > 0 AND average_natural_pitch_per_sentence < 1000 AND NOT isnan(average_natural_pitch_per_sentence), false)
        UNION ALL
        SELECT 'bdd_ssml', row_id, 'azure_voice_name' FROM bdd_ssml WHERE NOT coalesce(regexp_matches(azure_voice_name, '^fr-FR-.+Neural$'), false)""",
    # Level: median of 31 readings; spread: from the middle 68 % first, then of the readings within 4.5 of it.
    "p4_found": f"""
        WITH d AS (SELECT coalesce(voice, '') AS voice, CAST(regexp_extract(segment, '([0-9]+)$', 1) AS BIGINT) AS sn, segment, syn_no, row_id, unnest(['natural_pitch_syntagme', 'synthesized_pitch_syntagme', 'rate_adjustment']) AS f, unnest([natural_pitch_syntagme, synthesized_pitch_syntagme, rate_adjustment]) AS x
                   FROM bdd_syntagme_ssml WHERE regexp_matches(syntagme, '{_WS}')),
        r AS (SELECT voice, sn, segment, syn_no, f, min(x) AS x FROM d WHERE x IS NOT NULL AND NOT isnan(x) AND x <> 0 GROUP BY ALL),
        p AS (SELECT *, row_number() OVER (PARTITION BY voice, f ORDER BY sn, segment, syn_no) AS k, row_number() OVER (PARTITION BY voice, f ORDER BY sn, segment, syn_no) - row_number() OVER (PARTITION BY voice, f, x ORDER BY sn, segment, syn_no) AS island,
                   CASE WHEN f = 'rate_adjustment' THEN abs(x) > 100 ELSE x < 0 OR x > 1000 END AS imp FROM r),
        q AS (SELECT *, count(*) OVER (PARTITION BY voice, f, x, island) >= 6 AS stuck FROM p),
        n AS (SELECT *, x - median(x) OVER (PARTITION BY voice, f ORDER BY k ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) AS u FROM q WHERE NOT imp AND NOT stuck),
        s0 AS (SELECT voice, f, 1.4826 * median(abs(u)) AS s0 FROM n GROUP BY ALL),
        s AS (SELECT voice, f, sqrt(avg(u * u) FILTER (abs(u) <= 4.5 * s0)) AS sd FROM n JOIN s0 USING (voice, f) GROUP BY ALL),
        bad AS (SELECT voice, f, segment, syn_no FROM q WHERE imp OR stuck UNION ALL SELECT voice, f, segment, syn_no FROM n JOIN s USING (voice, f) WHERE abs(u) > 5.5 * sd)
        SELECT d.row_id, d.f AS field_name FROM d JOIN bad ON d.voice = bad.voice AND d.f = bad.f AND d.segment IS NOT DISTINCT FROM bad.segment AND d.syn_no IS NOT DISTINCT FROM bad.syn_no""",
    "p5_found": f"""
        WITH raw AS (
          SELECT voice, segment, {_NUM("begin_syntagme_natural")} AS b, {_NUM("end_syntagme_natural")} AS e,
                 CASE WHEN NOT isnan(duration_syntagme_natural) AND duration_syntagme_natural > 0 AND duration_syntagme_natural < 600 THEN duration_syntagme_natural END AS d
          FROM bdd_syntagme_ssml WHERE regexp_matches(syntagme, '{_WS}')),
        ms AS (SELECT voice, segment, coalesce({_MS("b")}, {_MS("e")} - {_MS("d")}) AS b, coalesce({_MS("e")}, {_MS("b")} + {_MS("d")}) AS e FROM raw),
        iv AS (SELECT voice, segment, least(b, e) AS b, greatest(b, e) AS e FROM ms WHERE b IS NOT NULL AND e IS NOT NULL),
        o AS (SELECT *, max(e) OVER (PARTITION BY voice, segment ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM iv),
        k AS (SELECT *, sum(CASE WHEN pe IS NULL OR b - pe > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY voice, segment ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS n FROM o),
        p AS (SELECT voice, segment, n, min(b) AS begin_ms, max(e) AS end_ms FROM k GROUP BY ALL)
        SELECT voice, segment, 'period' AS kind, begin_ms, end_ms FROM p
        UNION ALL
        SELECT voice, segment, 'gap', end_ms, nxt FROM (SELECT *, lead(begin_ms) OVER (PARTITION BY voice, segment ORDER BY n) AS nxt FROM p) WHERE nxt IS NOT NULL""",
}
