"""Interval errors by level against a plain loop over lists."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from prosarium.operators import evaluation, folds

NAMES = ("start", "end", "dur")


def pairs(gold, pred):
    norm = lambda t: re.sub(r"[^\w\s]", "", t.lower()).strip()
    used, out = set(), []
    for _, b, e, t in gold:
        best, top = None, 0
        for i, (_, pb, pe, u) in enumerate(pred):
            x, y = norm(t), norm(u)
            s = 1 if x == y else 0.8 if x in y or y in x else 0.5 if set(x.split()) & set(y.split()) else 0
            if i not in used and s > top:
                best, top = i, s
        if best is not None:
            used.add(best)
            _, pb, pe, _ = pred[best]
            out.append((abs(b - pb), abs(e - pe), abs((e - b) - (pe - pb))))
    return out


def test_levels_match_brute_force(spark):
    rng = random.Random(4)
    words = ["Un", "un chat", "chat!", "le", "chien noir", "noir.", "été"]
    make = lambda k: [(k, i, b := round(rng.uniform(0, 50), 2), round(b + rng.uniform(0.1, 9), 2), rng.choice(words)) for i in range(25)]
    gold, pred = [r for k in ("a", "b", "c") for r in make(k)], [r for k in ("a", "b") for r in make(k)]
    gold.append(("a", 99, None, 4.0, "le"))
    kind = "v string, o int, b double, e double, t string"
    g, p = spark.createDataFrame(gold, kind), spark.createDataFrame(pred, kind)
    sentences = folds.gap_sessions(p, ["v"], "b", "e", 0.5, 8.0).withColumn("s_no", F.round(F.col("s_start") * 1000).cast("long")).cache()
    got = {(r["v"], r["level"], r["part"]): r for r in evaluation.interval_errors(g, p, ["v"], "o", "b", "e", "t", sentences=sentences).collect()}
    want = {}
    for v in ("a", "b", "c"):
        mine = [[r[1:] for r in rows if r[0] == v and r[2] is not None] for rows in (gold, pred)]
        spans = [("entire", 0, -1e9, 1e9), *(("window", w, 15.0 * w, 15.0 * w + 15) for w in range(5)), *(("sentence", r["s_no"], r["s_start"], r["s_end"]) for r in sentences.where(F.col("v") == v).collect())]
        for level, part, lo, hi in spans:
            a, b = ([r for r in rows if r[1] < hi and r[2] > lo] for rows in mine)
            if a:
                want[v, level, part] = (len(a), pairs(a, b))
    assert set(got) == set(want) and len(want) > 20
    for k, (n, errors) in want.items():
        r = got[k]
        assert (r["gold"], r["matched"]) == (n, len(errors)) and np.isclose(r["arr"], len(errors) / n)
        for i, w in enumerate(NAMES):
            x = np.array([e[i] for e in errors])
            if len(x):
                assert np.isclose(r[f"mae_{w}"], x.mean()) and np.isclose(r[f"rmse_{w}"], np.sqrt((x**2).mean()))
            else:
                assert r[f"mae_{w}"] is None
    words_of = {r["v"]: r for r in evaluation.word_errors(g, p, ["v"], "o", "b", "e", "t").collect()}
    assert set(words_of) == {"a", "b"}
    for v, r in words_of.items():
        x = np.array([e[0] for e in want[v, "entire", 0][1]])
        assert r["words"] == len(x) and np.isclose(r["median_start"], np.median(x)) and np.isclose(r["max_start"], x.max())
    summary = {(r["v"], r["level"]): r for r in evaluation.level_summary(evaluation.interval_errors(g, p, ["v"], "o", "b", "e", "t"), ["v"]).collect()}
    shares = [len(e) / n for (v, level, _), (n, e) in want.items() if (v, level) == ("a", "window")]
    assert np.isclose(summary["a", "window"]["std_arr"], np.std(shares)) and summary["a", "window"]["parts"] == len(shares)
    assert evaluation.interval_errors(g.limit(0), p, ["v"], "o", "b", "e", "t").count() == 0
