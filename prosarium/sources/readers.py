"""Files to tables. Every reader takes a path or folder that Spark can read; parsing is on columns, so that
the parsers also work on text that is already in a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def read_table_csv(spark: SparkSession, path: str, schema: str = schemas.SEGMENTS) -> DataFrame:
    """CSV with a header and explicit types (texts that look like numbers stay texts)."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """stem, line_no (within its file), line. Files are read whole, so they must be small; there may be any number."""
    files = spark.read.text(path, wholetext=True).select(file_stem(F.input_file_name()).alias("stem"), "value")
    return files.select("stem", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line")).where(F.trim("line") != "")


def alignment_pair(line: Column) -> Column:
    """S3: the two sides of an alignment line, parted by || with white space around; null if it isn't one."""
    parts = F.split(line, r"\s*\|\|\s*")
    return F.when(F.size(parts) == 2, F.struct(parts[0].alias("synthesized"), parts[1].alias("natural")))


def read_alignments(spark: SparkSession, folder: str) -> DataFrame:
    """S3: all lines of a folder's *.txt with file_no (last number of the name), in which order they belong; bad lines are left out."""
    rows = lines_of(spark, f"{folder}/*.txt").withColumn("p", alignment_pair(F.col("line"))).where(F.col("p").isNotNull())
    return rows.select("stem", F.regexp_extract("stem", r"(\d+)(?!.*\d)", 1).try_cast("int").alias("file_no"), "line_no", "p.*")


def textgrid_tiers(value: Column) -> Column:
    """Array of (name, body) of a TextGrid's interval tiers."""
    body = r'(?s)class = "IntervalTier"\s*name = "((?:[^"]|"")*)"(.*?)(?=item \[\d+\]:|\z)'
    return F.arrays_zip(F.regexp_extract_all(value, F.lit(body), F.lit(1)).alias("name"), F.regexp_extract_all(value, F.lit(body), F.lit(2)).alias("body"))


def textgrid_intervals(body: Column) -> Column:
    """Array of (xmin, xmax, mark) of a tier's body, in order; doubled quotes are read as one."""
    one = r'intervals \[\d+\]:?\s*xmin = ([0-9.eE+-]+)\s*xmax = ([0-9.eE+-]+)\s*text = "((?:[^"]|"")*)"'
    x = lambda i: F.regexp_extract_all(body, F.lit(one), F.lit(i))
    return F.transform(F.arrays_zip(x(1).alias("a"), x(2).alias("b"), x(3).alias("t")), lambda r: F.struct(r["a"].try_cast("double").alias("xmin"), r["b"].try_cast("double").alias("xmax"), F.replace(r["t"], F.lit('""'), F.lit('"')).alias("mark")))


def intervals_of(df: DataFrame, value: str, tier: str | None = None) -> DataFrame:
    """df's other columns, idx, xmin, xmax, mark of the first tier, or of the one with the name, whatever its case; an error if none has it."""
    tiers = textgrid_tiers(F.col(value))
    chosen = tiers[0] if tier is None else F.get(F.filter(tiers, lambda t: F.lower(t["name"]) == tier.lower()), F.lit(0))
    body = F.coalesce(chosen["body"], F.raise_error(F.lit(f"no tier {tier}")).cast("string")) if tier else chosen["body"]
    keep = [c for c in df.columns if c != value]
    return df.select(*keep, F.posexplode(textgrid_intervals(body)).alias("idx", "r")).select(*keep, "idx", "r.*")


def read_textgrids(spark: SparkSession, folder: str, tier: str | None = None) -> DataFrame:
    """All *.TextGrid below a folder: stem, idx, xmin, xmax, mark."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.TextGrid").text(folder, wholetext=True)
    return intervals_of(files.select(file_stem(F.input_file_name()).alias("stem"), "value"), "value", tier)


def gold_intervals(intervals: DataFrame, lower: bool = False) -> DataFrame:
    """Marked intervals with their duration, in small letters if asked."""
    mark = F.lower("mark") if lower else F.col("mark")
    return intervals.where(F.trim("mark") != "").withColumns({"mark": mark, "duration": F.col("xmax") - F.col("xmin")})


def textgrid_text(value: Column) -> Column:
    """The marks of all lines 'text = ...', cut at a second '=', without [..], commas and semicolons, joined by spaces."""
    marks = F.transform(F.filter(F.split(value, r"\r?\n"), lambda x: F.contains(x, F.lit("text = "))), lambda x: F.trim(F.translate(F.regexp_replace(F.split(x, "=")[1], r"\[.*?\]", ""), '",;', "")))
    return F.array_join(F.filter(marks, lambda m: m != ""), " ")


def read_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """JSON results of a recogniser: stem, the columns of TRANSCRIPT, joined (texts of the segments)."""
    rows = spark.read.schema(schemas.TRANSCRIPT).option("multiLine", True).json(folder)
    return rows.withColumns({"stem": file_stem(F.input_file_name()), "joined": F.array_join(F.transform("segments", lambda s: F.trim(s["text"])), " ")})


def transcript_words(df: DataFrame) -> DataFrame:
    """Words of transcripts: stem, seg_no, word_no, start, end, text, confidence."""
    s = df.select("stem", F.posexplode("segments").alias("seg_no", "s"))
    return s.select("stem", "seg_no", F.posexplode("s.words").alias("word_no", "w")).select("stem", "seg_no", "word_no", "w.*")


def corpus_records(value: Column) -> Column:
    """A corpus file (a JSON object by voice) as a map; null if it isn't one."""
    return F.from_json(value, schemas.CORPUS)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Voice, x, y of every voice of a corpus file."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.explode(corpus_records(F.col("value"))).alias("voice", "r")).select("voice", "r.*")


def read_json_folder(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Objects and lists of objects of all *.json; files that are no JSON give nothing."""
    files = spark.read.text(f"{folder}/*.json", wholetext=True).select(file_stem(F.input_file_name()).alias("stem"), F.trim("value").alias("v"))
    many = F.from_json(F.when(F.startswith("v", F.lit("[")), F.col("v")).otherwise(F.concat(F.lit("["), "v", F.lit("]"))), f"array<struct<{schema}>>")
    return files.select("stem", F.explode(many).alias("r")).where(F.col("r").isNotNull()).select("stem", "r.*")


def read_splits(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Train, validation and test files of a folder with their split."""
    parts = [read_json_folder(spark, f"{folder}/{s}", schema).withColumn("split", F.lit(s)) for s in ("train", "validation", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def result_name(stem: Column) -> Column:
    """(model, mode) of '{model}_{zero,few}_shot'; null for other names."""
    g = lambda i: F.regexp_extract(stem, r"^(.+)_((?:zero|few)_shot)$", i)
    return F.when(g(1) != "", F.struct(g(1).alias("model"), g(2).alias("mode")))


def lexicon_entry(line: Column) -> Column:
    """First token in small letters, and the rest."""
    t = F.split(F.trim(line), r"\s+", 2)
    return F.when(F.size(t) == 2, F.struct(F.lower(t[0]).alias("word"), t[1].alias("phones")))


def boundary_entry(line: Column) -> Column:
    """(timestamp, label) of a line with at least three tokens: the first and the last."""
    t = F.split(F.trim(line), r"\s+")
    return F.when((F.size(t) >= 3) & t[0].try_cast("double").isNotNull(), F.struct(t[0].try_cast("double").alias("timestamp"), F.element_at(t, -1).alias("label")))


def span_entry(line: Column, least: float = 0.005) -> Column:
    """(start, end, word) of 'start-end: word'; spans without length get `least`; null for other lines."""
    g = lambda i: F.regexp_extract(line, r"^\s*([0-9.]+)\s*-\s*([0-9.]+)\s*:\s*(\S.*?)\s*$", i)
    a, b = g(1).try_cast("double"), g(2).try_cast("double")
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("start"), F.when(a == b, b + least).otherwise(b).alias("end"), g(3).alias("word")))


def ctm_entry(line: Column) -> Column:
    """(file, start, dur, word) of 'file channel start dur word ...'; <space> is read as a space."""
    t = F.split(F.trim(line), r"\s+")
    return F.when(F.size(t) >= 5, F.struct(t[0].alias("file"), t[2].try_cast("double").alias("start"), t[3].try_cast("double").alias("dur"), F.replace(t[4], F.lit("<space>"), F.lit(" ")).alias("word")))


def read_entries(spark: SparkSession, path: str, entry) -> DataFrame:
    """The lines of files that the entry function reads: stem, line_no and its fields."""
    return lines_of(spark, path).withColumn("e", entry(F.col("line"))).where(F.col("e").isNotNull()).select("stem", "line_no", "e.*")


def dataset_files(spark: SparkSession, folder: str, pattern: str = "*", excluded: str = r"_microsoft(/|$)") -> DataFrame:
    """Path, speaker and episode folder and size of all files below a folder, without those in excluded folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path", "length")
    parent = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    return files.where(~F.regexp_replace("path", r"/[^/]+$", "/").rlike(excluded)).select("path", "length", parent.alias("voice"), F.regexp_extract(parent, r"^(.+?)(?:_EP\d+)?$", 1).alias("speaker"))
