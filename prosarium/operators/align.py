"""Sequence alignment and matching inside short groups (a segment, a file): dynamic programmes in
numpy, run per group by Arrow batches. Groups are segments, so memory is bounded by a segment."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import alignment_token, loose, strip_all, without_punctuation
from ..functions.vectorised import vectorised
from .ranking import null_safe_join


def _spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Small groups whose work is in Python: as many tasks as the session's shuffles have, however few bytes they hold."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def global_pairs(a: list[str], b: list[str], match: int = 1, mismatch: int = -1, gap: int = -1) -> list[tuple[int, int]]:
    """A1: index pairs of the best global alignment, -1 for a gap. On the way back a pair is preferred to an
    item of the left alone, that to one of the right alone."""
    n, m = len(a), len(b)
    score = np.zeros((n + 1, m + 1), np.int64)
    score[:, 0], score[0, :] = np.arange(n + 1) * gap, np.arange(m + 1) * gap
    right = np.array(b, dtype=object)
    steps = np.arange(m + 1) * gap
    for i in range(1, n + 1):
        same = np.where(right == a[i - 1], match, mismatch).astype(np.int64) if m else np.zeros(0, np.int64)
        row = np.empty(m + 1, np.int64)
        row[0] = score[i, 0]
        row[1:] = np.maximum(score[i - 1, :-1] + same, score[i - 1, 1:] + gap)
        score[i] = np.maximum.accumulate(row - steps) + steps  # chains of gaps to the right
    out, i, j, at = [], n, m, score.tolist()
    while i or j:
        if i and j and at[i][j] == at[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else mismatch):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and at[i][j] == at[i - 1][j] + gap:
            i -= 1
            out.append((i, -1))
        else:
            j -= 1
            out.append((-1, j))
    return out[::-1]


def best_similarity_pairs(sim: np.ndarray) -> list[tuple[int, int]]:
    """A2: one-to-one pairs in order with the greatest sum of similarities. On ties skipping on the left comes
    before skipping on the right, and a pair must be strictly better than either."""
    n, m = sim.shape
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    move = [[0] * (m + 1) for _ in range(n + 1)]
    for i, row in enumerate(sim.tolist(), 1):
        for j, s in enumerate(row, 1):
            up, left, both = best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + s
            k = 0 if up >= left and up >= both else 1 if left >= both else 2
            best[i][j], move[i][j] = (up, left, both)[k], k
    out, i, j = [], n, m
    while i and j:
        k = move[i][j]
        if k == 2:
            out.append((i - 1, j - 1))
        i, j = i - (k != 1), j - (k != 0)
    return out[::-1]


def ratio(a: str, b: str) -> float:
    """Matching-blocks similarity of two texts."""
    return SequenceMatcher(None, a, b).ratio()


@vectorised("double")
def _ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def text_similarity(a: Column, b: Column) -> Column:
    """A7 on columns, after the loose normalisation; null if either is."""
    return _ratio(loose(a), loose(b))


def word_edits(ref: list[str], hyp: list[str]) -> int:
    """Least number of changed, added and missing words."""
    row = np.arange(len(hyp) + 1)
    words = np.array(hyp, dtype=object)
    steps = np.arange(len(hyp) + 1)
    for i, w in enumerate(ref, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (words != w), row[1:] + 1) if len(hyp) else new[1:]
        row = np.minimum.accumulate(new - steps) + steps
    return int(row[-1])


@vectorised("double")
def _wer(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([None if x is None or y is None or not x.split() else word_edits(x.split(), y.split()) / len(x.split()) for x, y in zip(a, b)], dtype="float64")


def word_error_rate(ref: Column, hyp: Column) -> Column:
    """Word edits over reference words; null for null texts and references without words."""
    return _wer(ref, hyp)


def dtw_rmse(a: np.ndarray, b: np.ndarray) -> float:
    """Root mean square difference along the exact best warping path."""
    n, m = len(a), len(b)
    if not n or not m:
        return float("nan")
    cost = np.abs(a[:, None] - b[None, :]).tolist()
    total = [[float("inf")] * (m + 1) for _ in range(n + 1)]
    total[0][0] = 0.0
    for i in range(1, n + 1):
        above, row, costs = total[i - 1], total[i], cost[i - 1]
        for j in range(1, m + 1):
            row[j] = costs[j - 1] + min(above[j - 1], above[j], row[j - 1])
    i, j, squares, steps = n, m, 0.0, 0
    while i and j:
        squares += cost[i - 1][j - 1] ** 2
        steps += 1
        ways = (total[i - 1][j - 1], total[i - 1][j], total[i][j - 1])
        k = ways.index(min(ways))
        i, j = i - (k != 2), j - (k != 1)
    return (squares / steps) ** 0.5


@vectorised("double")
def _dtw(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        logs = lambda s: np.log(np.array([x for x in s if x is not None and x > 0], float))
        yield pd.Series([None if x is None or y is None else dtw_rmse(logs(x), logs(y)) for x, y in zip(a, b)], dtype="float64")


def pitch_contour_distance(a: Column, b: Column) -> Column:
    """A9 on arrays of F0: over the logarithms of the voiced frames; NaN if either has none."""
    return _dtw(a, b)


def align_tables(left: DataFrame, right: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """A1 per group: keys, pair_no, left_order, right_order (null for a gap). Groups on one side only have no rows."""
    one = lambda df: df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).cast("bigint").alias("o"), F.coalesce(alignment_token(F.col(text)), F.lit("")).alias("t")))).alias("__a"))
    both = _spread(one(left).withColumnRenamed("__a", "__l").join(one(right), keys), keys)
    made = both.withColumn("__p", _pairs(F.transform("__l", lambda s: s["t"]), F.transform("__a", lambda s: s["t"])))
    at = lambda a, i: F.when(i >= 0, F.get(F.col(a), i)["o"])
    rows = made.select(*keys, F.posexplode_outer("__p").alias("pair_no", "__x"), "__l", "__a").where(F.col("__x").isNotNull())
    return rows.select(*keys, "pair_no", at("__l", F.col("__x.i")).alias("left_order"), at("__a", F.col("__x.j")).alias("right_order"))


@vectorised("array<struct<i:int,j:int>>")
def _pairs(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([[{"i": i, "j": j} for i, j in global_pairs(list(x), list(y))] for x, y in zip(a, b)])


@vectorised("array<struct<i:int,j:int,sim:double>>")
def _chunk_pairs(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        out = []
        for x, y in zip(a, b):
            sim = np.array([[ratio(p, q) for q in y] for p in x]).reshape(len(x), len(y))
            out.append([{"i": i, "j": j, "sim": float(sim[i, j])} for i, j in best_similarity_pairs(sim)])
        yield pd.Series(out)


def match_chunks(left: DataFrame, right: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """A2 per group: keys, left_no, right_no (from 0), similarity."""
    one = lambda df: df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, loose(F.col(text)).alias("t")))), lambda s: s["t"]).alias("__a"))
    both = _spread(one(left).withColumnRenamed("__a", "__l").join(one(right), keys), keys)
    return both.select(*keys, F.explode_outer(_chunk_pairs("__l", "__a")).alias("p")).where(F.col("p").isNotNull()).select(*keys, F.col("p.i").alias("left_no"), F.col("p.j").alias("right_no"), F.col("p.sim").alias("similarity"))


def spans_of_matches(matches: DataFrame, keys: list[str], right_counts: DataFrame) -> DataFrame:
    """A3: each matched left chunk owns the right chunks from its own to before the next match's (the last one to the end):
    keys, left_no, right_no, last_right. `right_counts` has keys and n_right."""
    nxt = F.lead("right_no").over(Window.partitionBy(*keys).orderBy("left_no"))
    return matches.withColumn("__next", nxt).join(right_counts, keys).select(*keys, "left_no", "right_no", (F.coalesce("__next", "n_right") - 1).alias("last_right"))


class _Tier:
    """A tier that is walked word by word; a pending word may take in the words after it."""

    def __init__(self, words: list[dict]):
        self.words, self.at, self.out = words, 0, []
        self.since = words[0]["xmin"] if words else 0.0
        self.pending = words[0]["mark"] if words else ""

    @property
    def following(self) -> str | None:
        return self.words[self.at + 1]["mark"] if self.at + 1 < len(self.words) else None

    def take(self, mark: str) -> None:
        """The pending word ends with the current interval, under this mark."""
        until = self.words[self.at]["xmax"]
        self.out.append((mark, self.since, until))
        self.since = until
        self.at += 1
        self.pending = self.words[self.at]["mark"] if self.at < len(self.words) else ""

    def join(self) -> None:
        self.at += 1
        self.pending += " " + self.words[self.at]["mark"]


def merge_tiers(a: list[dict], b: list[dict]) -> tuple[list[tuple], list[tuple]]:
    """A5: two tiers of (mark, xmin, xmax) brought together, each as (mark, xmin, xmax) that follow without holes.

    Blank words stand by themselves. A pending word is joined with the next one of its tier, again and again, as long as that
    brings it closer to the other tier's pending word; the first tier goes first. Then both get the longer of the two
    words. A last word has nothing to be joined with. What one tier has left over stands alone."""
    x, y = _Tier(a), _Tier(b)
    while x.at < len(a) and y.at < len(b):
        if not x.pending.strip():
            x.take(" ")
        elif not y.pending.strip():
            y.take(" ")
        else:
            here = _levenshtein(x.pending, y.pending)
            left = here if x.following is None else _levenshtein(x.pending + x.following, y.pending)
            right = here if y.following is None else _levenshtein(x.pending, y.pending + y.following)
            if here <= min(left, right):
                mark = max(x.pending, y.pending, key=len)
                x.take(mark)
                y.take(mark)
            else:
                (x if left <= right else y).join()
    for t in (x, y):
        while t.at < len(t.words):
            t.take(t.pending)
    return x.out, y.out


def _levenshtein(a: str, b: str) -> int:
    return word_edits(list(a), list(b))


@vectorised("array<struct<tier:int,no:int,mark:string,xmin:double,xmax:double>>")
def _merged(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([[{"tier": t, "no": i, "mark": m, "xmin": lo, "xmax": hi} for t, rows in enumerate(merge_tiers(list(x), list(y))) for i, (m, lo, hi) in enumerate(rows)] for x, y in zip(a, b)])


def merged_tiers(df: DataFrame, keys: list[str], a: Column, b: Column) -> DataFrame:
    """A5 on arrays of struct(mark, xmin, xmax): keys, tier (0 or 1), no, mark, xmin, xmax."""
    rows = df.select(*keys, F.explode_outer(_merged(a, b)).alias("__r"))
    return rows.where(F.col("__r").isNotNull()).select(*keys, "__r.*")


def best_words(synth: list[str], natural: list[str]) -> list[int]:
    """For each synthetic word the place of a natural word, -1 if there is none: the first equal one, else the first
    of those with the greatest ratio of lengths of which one contains the other."""
    first: dict[str, int] = {}
    for k, w in enumerate(natural):
        first.setdefault(w, k)
    known: dict[str, int] = {}
    for s in synth:
        if s not in known:
            best, top = first.get(s, -1), 0.0
            if best < 0:
                for n, k in first.items():  # in order of place
                    if s and n and (s in n or n in s) and (r := min(len(s), len(n)) / max(len(s), len(n))) > top:
                        best, top = k, r
            known[s] = best
    return [known[s] for s in synth]


@vectorised("array<int>")
def _best(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([best_words(list(x), list(y)) for x, y in zip(a, b)])


def best_word(df: DataFrame, keys: list[str], synth: str, natural: str) -> DataFrame:
    """J14 on two arrays of words per row: keys, synth_no, natural_no. Distinct words are compared inside the row, no pairs are emitted."""
    rows = df.where(F.col(synth).isNotNull() & F.col(natural).isNotNull()).select(*keys, _best(synth, natural).alias("__b"))
    return rows.select(*keys, F.posexplode_outer("__b").alias("synth_no", "natural_no")).where(F.col("natural_no") >= 0)


def greedy_text_pairs(gold: list[str], pred: list[str]) -> list[tuple[int, int, float]]:
    """Each gold text in turn takes the first unused predicted text of the greatest score: 1 equal, 0.8 one inside the
    other, 0.5 a common word. Texts come normalised."""
    used: set[int] = set()
    out = []
    for g, a in enumerate(gold):
        best, top = -1, 0.0
        words = set(a.split())
        for p, b in enumerate(pred):
            if p not in used:
                s = 1.0 if a == b else 0.8 if a in b or b in a else 0.5 if words & set(b.split()) else 0.0
                if s > top:
                    best, top = p, s
        if best >= 0:
            used.add(best)
            out.append((g, best, top))
    return out


@vectorised("array<struct<g:int,p:int,score:double>>")
def _greedy(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([[{"g": g, "p": p, "score": s} for g, p, s in greedy_text_pairs(list(x), list(y))] for x, y in zip(a, b)])


def greedy_match(gold: DataFrame, pred: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """J15 per group: keys, gold_no, pred_no, score."""
    one = lambda df: df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, F.coalesce(F.col(text), F.lit("")).alias("t")))), lambda s: s["t"]).alias("__a"))
    both = _spread(one(gold).withColumnRenamed("__a", "__g").join(one(pred), keys), keys)
    return both.select(*keys, F.explode_outer(_greedy("__g", "__a")).alias("r")).where(F.col("r").isNotNull()).select(*keys, F.col("r.g").alias("gold_no"), F.col("r.p").alias("pred_no"), F.col("r.score").alias("score"))


def paired_intervals(gold: DataFrame, pred: DataFrame, keys: list[str], order: str, begin: str, end: str, text: str) -> DataFrame:
    """Groups of gold intervals with the errors of their pairs by J15: keys, gold (their number), errors, an array of
    absolute errors start, end and dur, one for each pair. Groups without predicted intervals have no pair."""
    held = lambda df, name: df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(strip_all(without_punctuation(F.col(text))), F.lit("")).alias("t"), F.col(begin).alias("b"), F.col(end).alias("e")))).alias(name))
    both = _spread(null_safe_join(held(gold, "__g"), held(pred, "__p"), keys, "left"), keys)
    texts = lambda c: F.coalesce(F.transform(c, lambda s: s["t"]), F.array().cast("array<string>"))
    made = both.withColumn("__m", _greedy(texts("__g"), texts("__p")))
    at = lambda m: (F.get("__g", m["g"]), F.get("__p", m["p"]))
    error = lambda g, p: F.struct(F.abs(g["b"] - p["b"]).alias("start"), F.abs(g["e"] - p["e"]).alias("end"), F.abs(g["e"] - g["b"] - (p["e"] - p["b"])).alias("dur"))
    return made.select(*keys, F.size("__g").alias("gold"), F.transform("__m", lambda m: error(*at(m))).alias("errors"))


def break_hits(ref: list[float], sys: list[float], tol: float = 0.3) -> int:
    """Reference breaks that find an unused system break within `tol`, in order."""
    used: set[int] = set()
    for r in ref:
        for i, s in enumerate(sys):
            if i not in used and abs(r - s) <= tol:
                used.add(i)
                break
    return len(used)


@vectorised("int")
def _hits(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([break_hits(list(x), list(y)) for x, y in zip(a, b)], dtype="int32")


def break_scores(df: DataFrame, ref: str, sys: str) -> DataFrame:
    """J16 on arrays of seconds: adds hits, precision, recall, f1 (0 where undefined)."""
    held = lambda c: F.coalesce(F.filter(F.col(c), lambda x: x.isNotNull()), F.array().cast("array<double>"))
    hits = df.withColumn("hits", _hits(held(ref), held(sys)))
    p, r = F.coalesce(F.try_divide("hits", F.size(held(sys))), F.lit(0.0)), F.coalesce(F.try_divide("hits", F.size(held(ref))), F.lit(0.0))
    return hits.withColumns({"precision": p, "recall": r}).withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
