"""Training-set construction: parsing SSML into sequences, chunking, merging, splitting, sampling."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_count
from .ranking import null_safe_join
from ..functions.vectorised import vectorised
from .ranking import sharded_row_number, windowed_in_blocks

ELEMENT = "struct<segment:string,type:string,text:string,time:string,prosody:struct<pitch:string,rate:string,volume:string>>"
SEQUENCE = f"array<{ELEMENT}>"


def canonical_sequence(seq: Column) -> Column:
    """Elements without nulls, types in small letters without white space around."""
    held = F.filter(seq, lambda e: e.isNotNull())
    return F.transform(held, lambda e: F.struct(e["segment"].alias("segment"), F.lower(F.trim(e["type"])).alias("type"), e["text"].alias("text"), e["time"].alias("time"), e["prosody"].alias("prosody")))


def parse_ssml(ssml: Column, segment: Column) -> Column:
    """X1 inside the JVM: SEQUENCE of a document whose prosody elements hold text and breaks.

    All prosody elements are read, in order, with the breaks between them, so documents of several
    elements lose nothing. Anything else between tags is left out.
    """
    tokens = F.regexp_extract_all(ssml, F.lit(r"(?s)(<prosody[^>]*>|</prosody>|<break[^>]*/?>|<[^>]+>|[^<]+)"), F.lit(1))
    attr = lambda t, a: F.regexp_extract(t, rf'{a}="([^"]*)"', 1)
    none = F.lit(None).cast("string")
    start = F.struct(none.alias("tag"), F.array().cast(SEQUENCE).alias("out"))

    def step(s: Column, t: Column) -> Column:
        opens, closes, brk = F.startswith(t, F.lit("<prosody")), t == "</prosody>", F.startswith(t, F.lit("<break"))
        text = ~F.startswith(t, F.lit("<")) & s["tag"].isNotNull() & (F.trim(t) != "")
        values = F.when(text, F.struct(attr(s["tag"], "pitch").alias("pitch"), attr(s["tag"], "rate").alias("rate"), attr(s["tag"], "volume").alias("volume")))
        element = F.struct(segment.alias("segment"), F.when(brk, "break").otherwise("text").alias("type"), F.when(text, F.trim(t)).alias("text"), F.when(brk, attr(t, "time")).alias("time"), values.alias("prosody"))
        return F.struct(F.when(opens, t).when(closes, none).otherwise(s["tag"]).alias("tag"), F.when(brk | text, F.concat(s["out"], F.array(element))).otherwise(s["out"]).alias("out"))

    return F.aggregate(tokens, start, step, lambda s: s["out"])


def merge_by_segment(df: DataFrame, keys: list[str], maps: str) -> DataFrame:
    """Maps of segment -> array of strings of one key merged, arrays of a segment concatenated in order of `ord`.
    Rows are keyed (key, segment) while merging; the map is put together last."""
    rows = df.select(*keys, "ord", F.explode(maps).alias("segment", "strings"))
    per = rows.groupBy(*keys, "segment").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "strings"))), lambda s: F.coalesce(s["strings"], F.array().cast("array<string>")))).alias("strings"))
    return per.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("segment", "strings")))).alias(maps))


def chunk_bounds(words: list[int], ends: list[bool], limit: int = 100, backtrack: bool = True) -> list[int]:
    """End index of each chunk of tokens. A chunk is closed before the token that would exceed the limit:
    after its last token that ends a sentence, if there is one, and the rest is carried over; else right there."""
    out, begin, count = [], 0, 0
    for i, n in enumerate(words):
        if i > begin and count + n > limit:
            cut = next((k + 1 for k in range(i - 1, begin - 1, -1) if ends[k]), i) if backtrack else i
            out.append(cut)
            begin, count = cut, sum(words[cut:i])
        count += n
    if len(words) > begin:
        out.append(len(words))
    return out


@vectorised("array<struct<begin:int,size:int>>")
def _bounds(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for w, e, limit, back in batches:
        out = []
        for x, y, m, k in zip(w, e, limit, back):
            cuts = chunk_bounds([int(v) for v in x], [bool(v) for v in y], int(m), bool(k)) if x is not None else []
            out.append([{"begin": a, "size": b - a} for a, b in zip([0, *cuts], cuts)])
        yield pd.Series(out)


def chunk_rows(df: DataFrame, key: str, seq: str, limit: int = 100, backtrack: bool = True) -> DataFrame:
    """One row per chunk: id ('key', or 'key_partN' if there are several), chunk_no, chunk. Null and empty
    sequences have none. Only word counts and sentence marks go through Python, the elements stay in the JVM."""
    is_text = lambda e: F.coalesce(e["type"] == "text", F.lit(False))
    words = F.transform(F.col(seq), lambda e: F.when(is_text(e), word_count(e["text"])).otherwise(0))
    ends = F.transform(F.col(seq), lambda e: is_text(e) & F.coalesce(F.endswith(F.rtrim(e["text"]), F.lit(".")), F.lit(False)))
    cut = df.select(key, F.col(seq).alias("__s"), _bounds(words, ends, F.lit(limit), F.lit(backtrack)).alias("__c"))
    rows = cut.select(key, "__s", F.size("__c").alias("__n"), F.posexplode_outer("__c").alias("__i", "c")).where(F.col("c").isNotNull())
    name = F.when(F.col("__n") == 1, F.col(key).cast("string")).otherwise(F.concat(F.col(key).cast("string"), F.lit("_part"), (F.col("__i") + 1).cast("string")))
    return rows.select(name.alias("id"), (F.col("__i") + 1).alias("chunk_no"), F.slice("__s", F.col("c.begin") + 1, F.col("c.size")).alias("chunk"))


def segment_samples(df: DataFrame, key: str, seq: str) -> DataFrame:
    """One sample per (record, segment): key, segment, text and the segment's elements in order; segments without text are left out."""
    rows = df.select(key, F.posexplode(seq).alias("i", "e")).where(F.col("e").isNotNull())
    parts = rows.groupBy(key, F.col("e.segment").alias("segment")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "e"))), lambda s: s["e"]).alias("elements"))
    texts = F.filter(F.transform(F.filter("elements", lambda e: e["type"] == "text"), lambda e: F.trim(F.coalesce(e["text"], F.lit("")))), lambda t: t != "")
    return parts.withColumn("text", F.array_join(texts, " ")).where(F.col("text") != "")


def sequence_to_params(seq: Column) -> Column:
    """A break closes the open segment as its break_after, or opens one as its break_before; a text joins an open
    break or starts a segment of its own, which replaces one that is still open. A last open text is kept."""
    seg = "struct<break_before:string,text:string,prosody:struct<pitch:string,rate:string,volume:string>,break_after:string>"
    zero = F.struct(F.lit("0%").alias("pitch"), F.lit("0%").alias("rate"), F.lit("0%").alias("volume"))
    none = F.lit(None).cast(seg)
    start = F.struct(none.alias("open"), F.array().cast(f"array<{seg}>").alias("out"))

    def step(s: Column, e: Column) -> Column:
        now = s["open"]
        brk, text = e["type"] == "break", e["type"] == "text"
        time = F.coalesce(e["time"], F.lit("0ms"))
        make = lambda b, t, p, a: F.struct(b.cast("string").alias("break_before"), t.cast("string").alias("text"), p.alias("prosody"), a.cast("string").alias("break_after")).cast(seg)
        null = F.lit(None).cast("string")
        closed = make(now["break_before"], now["text"], now["prosody"], time)
        opened = make(time, null, F.lit(None).cast("struct<pitch:string,rate:string,volume:string>"), null)
        spoken = make(F.when(now.isNotNull() & now["text"].isNull(), now["break_before"]).otherwise("0ms"), F.coalesce(e["text"], F.lit("")), F.coalesce(e["prosody"], zero), null)
        return F.struct(F.when(brk, F.when(now.isNotNull(), none).otherwise(opened)).when(text, spoken).otherwise(now).alias("open"), F.when(brk & now.isNotNull(), F.concat(s["out"], F.array(closed))).otherwise(s["out"]).alias("out"))

    def done(s: Column) -> Column:
        last = F.struct(s["open"]["break_before"].alias("break_before"), s["open"]["text"].alias("text"), s["open"]["prosody"].alias("prosody"), F.lit("0ms").alias("break_after")).cast(seg)
        return F.when(s["open"].isNotNull() & s["open"]["text"].isNotNull(), F.concat(s["out"], F.array(last))).otherwise(s["out"])

    return F.aggregate(F.filter(seq, lambda e: e.isNotNull()), start, step, done)


def params_to_sequence(segments: Column) -> Column:
    """Breaks and texts of predicted segments in order; breaks of 0ms or none are left out."""
    none = F.lit(None).cast("string")
    no_prosody = F.lit(None).cast("struct<pitch:string,rate:string,volume:string>")
    brk = lambda t: F.when(t.isNotNull() & (t != "0ms"), F.array(F.struct(F.lit("break").alias("type"), none.alias("text"), t.alias("time"), no_prosody.alias("prosody")))).otherwise(F.array())
    item = "array<struct<type:string,text:string,time:string,prosody:struct<pitch:string,rate:string,volume:string>>>"
    one = lambda s: F.concat(brk(s["break_before"]).cast(item), F.array(F.struct(F.lit("text").alias("type"), s["text"].alias("text"), none.alias("time"), s["prosody"].alias("prosody"))).cast(item), brk(s["break_after"]).cast(item))
    return F.flatten(F.transform(F.filter(segments, lambda s: s.isNotNull()), one))


def _hash_position(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Adds __pos: the row's place in the order of a hash of its key, from 0, without a one-task window."""
    h = F.xxhash64(F.lit(seed), F.col(key))
    return sharded_row_number(df.withColumn("__h", h), [], F.shiftright("__h", 54), [F.col("__h"), F.col(key)], "__pos")


def shuffled_split(df: DataFrame, key: str, parts: dict[str, float], seed: int = 42) -> DataFrame:
    """Adds split. Rows are ordered by a hash of the key; every part but the last gets floor(n * share) rows, the last the rest."""
    return _cut(_hash_position(df, key, seed), parts).drop("__h", "__pos")


def sequential_split(df: DataFrame, order: str, parts: dict[str, float], shard: Column) -> DataFrame:
    """O3: the same in the order of a column; `shard` must rise with it. Shares must add up to 1."""
    if round(sum(parts.values()), 5) != 1 or any(not 0 <= p <= 1 for p in parts.values()):
        raise ValueError("shares must lie between 0 and 1 and add up to 1")
    return _cut(sharded_row_number(df, [], shard, [F.col(order)], "__pos"), parts).drop("__pos")


def _cut(df: DataFrame, parts: dict[str, float]) -> DataFrame:
    n = df.count()
    names, at, c = list(parts), 0, None
    for name in names[:-1]:
        at += int(n * parts[name])
        c = F.when(F.col("__pos") < at, name) if c is None else c.when(F.col("__pos") < at, name)
    return df.withColumn("split", c.otherwise(names[-1]) if c is not None else F.lit(names[-1]))


def hash_sample(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """K rows by the order of a hash of the key (a top-k, no sort of all rows)."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), F.col(key)).limit(k)


def example_pool(samples: DataFrame, evaluation: DataFrame, key: str, content: str, most: int, seed: int = 42) -> DataFrame:
    """Examples for prompts: the samples whose content is none of the evaluation samples'. If these are fewer than `most`,
    evaluation samples in the order of a hash of their key top them up. key, topped_up.

    A null content is a content like others."""
    rest = null_safe_join(samples, evaluation.select(content).distinct(), [content], "left_anti")
    short = most - rest.limit(most).count()
    pool = rest.select(key, F.lit(False).alias("topped_up"))
    if short <= 0:
        return pool
    more = evaluation.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(short)
    return pool.unionByName(more.select(key, F.lit(True).alias("topped_up")))


def checked_sample(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """As hash_sample, an error if there are fewer rows."""
    n = df.count()
    if n < k:
        raise ValueError(f"{k} rows asked for, {n} there")
    return hash_sample(df, key, k, seed)


def bootstrap(df: DataFrame, key: str, runs: int, seed: int = 42) -> DataFrame:
    """`runs` samples of n rows with replacement: adds run. Draw j of a run takes the row at place hash(run, j) mod n."""
    placed = _hash_position(df, key, seed).drop("__h")
    n = placed.count()
    draws = df.sparkSession.range(runs * n).select((F.col("id") / n).cast("int").alias("run"), F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(n)).alias("__pos"))
    return draws.join(placed, "__pos").drop("__pos")


def sliding_windows(df: DataFrame, keys: list[str], order: str, value: str, k: int) -> DataFrame:
    """Adds win, the k consecutive values around each row (the row at place k // 2), for complete windows only. `order` is a
    number that tells the rows of a key apart."""
    whole = windowed_in_blocks(df, keys, F.floor(F.col(order) / 1024), [F.col(order)], k // 2, k - 1 - k // 2, lambda w: {"win": F.collect_list(value).over(w)})
    return whole.where(F.size("win") == k)


def pack_segments(rows: list[tuple[int, float]], target: float, margin: float) -> list[tuple[list[int], float | None]]:
    """(segment numbers, seconds kept of the last or None) from (number, seconds) in order. Segments within
    the bounds stand alone. The rest is grouped along consecutive numbers up to the lower bound; a group beyond the upper
    bound loses its last segment, or has it cut if it is too short without. The first group that stays too short ends it."""
    low, high = target - margin, target + margin
    out: list[tuple[list[int], float | None]] = [([n], None) for n, d in rows if low <= d <= high]
    rest = [(n, d) for n, d in rows if not low <= d <= high]
    i = 0
    while i < len(rest):
        j, total = i, 0.0
        while j < len(rest) and total < low and (j == i or rest[j][0] == rest[j - 1][0] + 1):
            total += rest[j][1]
            j += 1
        if total < low:
            break
        numbers, before = [n for n, _ in rest[i:j]], total - rest[j - 1][1]
        if total <= high:
            out.append((numbers, None))
        elif before >= low:
            out.append((numbers[:-1], None))
            j -= 1
        else:
            out.append((numbers, target - before))
        i = j
    return out


def packed_segments(df: DataFrame, keys: list[str], number: str, seconds: str, target: float = 60.0, margin: float = 15.0) -> DataFrame:
    """I15 per group (an episode's segments): keys, chunk_no, segments, keep_last_s."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(number)
        packed = pack_segments(list(zip(pdf[number].astype(int), pdf[seconds])), target, margin)
        head = {k: [pdf[k].iloc[0]] * len(packed) for k in keys}
        return pd.DataFrame(head | {"chunk_no": np.arange(len(packed)), "segments": [[int(n) for n in p] for p, _ in packed], "keep_last_s": [k for _, k in packed]})

    known = df.where(F.col(seconds).isNotNull() & F.col(number).isNotNull())
    return known.groupBy(*keys).applyInPandas(run, f"{ddl}, chunk_no int, segments array<int>, keep_last_s double")


_FENCE = re.compile(r"```(?:json)?\s*(.*?)\s*```", re.S)
_THINK = re.compile(r"<think>.*?</think>", re.S)


def _balanced(text: str, opening: str, closing: str) -> list[str]:
    """Balanced stretches from an opening bracket, outermost first, longest first."""
    out, depth, begin, quoted, escaped = [], 0, 0, False, False
    for i, c in enumerate(text):
        if quoted:
            escaped, quoted = (c == "\\" and not escaped), quoted and (c != '"' or escaped)
        elif c == '"' and depth:
            quoted = True
        elif c == opening:
            begin, depth = (i if depth == 0 else begin), depth + 1
        elif c == closing and depth:
            depth -= 1
            if depth == 0:
                out.append(text[begin : i + 1])
    return sorted(out, key=len, reverse=True)


def recover_json(raw: str | None) -> str:
    """The JSON object in a model's answer, as text: a fenced block, else the largest object, else the largest array, else
    after mending quotes of names and commas before brackets; {"segments": []} if nothing helps. A list becomes its segments."""
    text = _THINK.sub("", raw or "")
    fenced = _FENCE.search(text)
    payload = fenced[1] if fenced else text.strip()
    mended = re.sub(r",(\s*[\]}])", r"\1", re.sub(r"'([^']+)'(\s*:)", r'"\1"\2', payload))
    for candidate in [*([payload] if fenced else []), *_balanced(payload, "{", "}"), *_balanced(payload, "[", "]"), mended]:
        try:
            value = json.loads(candidate)
        except ValueError:
            continue
        if isinstance(value, list):
            value = {"segments": value}
        if isinstance(value, dict):
            return json.dumps(value, ensure_ascii=False)
    return '{"segments": []}'


@vectorised("string")
def _recovered(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(recover_json)


PARAMS = "struct<segments:array<struct<text:string,break_before:string,break_after:string,prosody:struct<pitch:string,rate:string,volume:string>>>>"


def parse_answer(raw: Column) -> Column:
    """X15 on a column: struct of segments."""
    return F.from_json(_recovered(raw), PARAMS)


def respeed(ssml: str | None, rate: str) -> str | None:
    """The document's texts and breaks in order, each text (tails of breaks too) in a prosody of the given rate.
    Null for null and for what is no XML."""
    try:
        root = ElementTree.fromstring(ssml) if ssml else None
    except ElementTree.ParseError:
        return None
    if root is None:
        return None
    parts: list[str] = []

    def walk(e: ElementTree.Element) -> None:
        if e.tag.split("}")[-1] == "break":
            parts.append(f'<break time="{e.get("time", "0ms")}"/>')
        for t in [e.text]:
            say(t)
        for child in e:
            walk(child)
            say(child.tail)

    def say(t: str | None) -> None:
        if t and t.strip():
            parts.append(f'<prosody rate="{rate}">{t.strip()}</prosody>')

    walk(root)
    return "<speak>" + "".join(parts) + "</speak>"


@vectorised("string")
def _respeed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for s, r in batches:
        yield pd.Series([respeed(x, y) for x, y in zip(s, r)], dtype=object)


def respeed_column(ssml: Column, rate: str) -> Column:
    """X14 on a column."""
    return _respeed(ssml, F.lit(rate))


def few_shot_prompt(examples: DataFrame, text: str, params: str, order: str, most: int = 5) -> DataFrame:
    """One row with the prompt of the first `most` examples by order, numbered, with their parameters as indented JSON."""
    first = examples.orderBy(order).limit(most)
    item = F.concat(F.lit('Text: "'), text, F.lit('"\nParameters:\n```json\n'), F.to_json(params, {"pretty": "true"}), F.lit("\n```\n\n"))
    rows = first.agg(F.array_sort(F.collect_list(F.struct(order, item.alias("t")))).alias("a"))
    return rows.select(F.array_join(F.transform("a", lambda s, i: F.concat(F.lit("Example "), (i + 1).cast("string"), F.lit(":\n"), s["t"])), "").alias("prompt"))
