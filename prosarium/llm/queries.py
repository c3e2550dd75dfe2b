"""Queries of the text operators (p2, p6, p7, p8) and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .leakage import leaked_items
from .pieces import split_elements, split_texts
from .sentences import split_sentences
from .tokens import encode_texts

#: Folder of the public tokenizers' vocabulary files.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    texts = split_texts(table(spark, folder, "documents"), "doc_id", "text").withColumn("item_kind", F.lit("document"))
    records = split_elements(table(spark, folder, "corpus"), "record_id", "parsed_sequence", "text").withColumn("item_kind", F.lit("corpus"))
    return texts.unionByName(records).select("item_kind", "item_id", "piece_no", "begin_pos", "end_pos")


def p2_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of documents that end with sections, list items and elements of mark-up, too."""
    return split_texts(table(spark, folder, "documents"), "doc_id", "text", structure=True)


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_texts(table(spark, folder, "documents"), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.json")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_items(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "heldout_items"), "item_id", "text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return split_sentences(table(spark, folder, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p2_found, p2_sections, p6_ids, p7_found, p8_found)}
_W = r"[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_WIN = lambda s, a, b: f"substr(text, {s} + {a}, {b})"


def _cut(s: str) -> str:
    """End of the piece that starts at s: of each kind, the last place more than 750 and at most 1500 after it."""
    last = lambda w, base, p: f"CASE WHEN regexp_matches({w}, '{p}') THEN {s} + {base} + length(regexp_extract({w}, '{p}', 1)) END"
    blocks = last(_WIN(s, 750, 751), 749, r"(?s)^(.*\n\n)")
    marks = f"greatest({last(_WIN(s, 751, 751), 750, f'(?s)^(.*[.!?…]){_W}')}, {last(_WIN(s, 751, 750), 750, '(?s)^(.*[。！？।؟])')})"
    spaces = last(_WIN(s, 751, 750), 750, f"(?s)^(.*{_W})")
    return f"CASE WHEN n - ({s}) <= 1500 THEN n ELSE coalesce({blocks}, {marks}, {spaces}, {s} + 1500) END"


SQL: dict[str, str] = {
    "p2_found": f"""
        WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 1500),
        p AS (SELECT doc_id, text, n, 0 AS k, 0 AS s, {_cut("0")} AS e FROM d
              UNION ALL SELECT doc_id, text, n, k + 1, s, {_cut("s")} AS e FROM (SELECT doc_id, text, n, k, e - 100 AS s FROM p WHERE e < n)),
        w AS (SELECT record_id, list_transform(list_filter(list_transform(list_filter(parsed_sequence, lambda e1: e1 IS NOT NULL), lambda e2: struct_extract(e2, 'text')), lambda t: t IS NOT NULL), lambda t: list_filter(regexp_split_to_array(t, '{_W}+'), lambda v: v <> '')) AS ws FROM corpus WHERE parsed_sequence IS NOT NULL),
        c AS (SELECT record_id, flatten(ws) AS v, list_transform(range(1, len(ws) + 1), lambda i: list_sum(list_transform(ws[1:i], lambda l: len(l)))) AS ends FROM w WHERE len(flatten(ws)) > 100),
        b AS (SELECT record_id, len(v) AS n, list_filter(range(1, len(v) + 1), lambda i: regexp_matches(v[i], '[.!?…][»”")’''›]*$')) AS marks, ends FROM c),
        q AS (SELECT record_id, n, marks, ends, 0 AS k, 0 AS s, CASE WHEN n <= 100 THEN n ELSE coalesce(list_max(list_filter(marks, lambda x: x > 50 AND x <= 100)), list_max(list_filter(ends, lambda x: x > 50 AND x <= 100)), 100) END AS e FROM b
              UNION ALL SELECT record_id, n, marks, ends, k + 1, e - 10, CASE WHEN n - (e - 10) <= 100 THEN n ELSE coalesce(list_max(list_filter(marks, lambda x: x > e - 10 + 50 AND x <= e - 10 + 100)), list_max(list_filter(ends, lambda x: x > e - 10 + 50 AND x <= e - 10 + 100)), e - 10 + 100) END FROM q WHERE e < n)
        SELECT 'document' AS item_kind, doc_id AS item_id, CAST(k AS INTEGER) AS piece_no, CAST(s AS INTEGER) AS begin_pos, CAST(e AS INTEGER) AS end_pos FROM p
        UNION ALL SELECT 'corpus', record_id, CAST(k AS INTEGER), CAST(s AS INTEGER), CAST(e AS INTEGER) FROM q""",
}
