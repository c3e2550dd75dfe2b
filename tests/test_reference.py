"""Golden cases of the sequential operators, and every query that has SQL against DuckDB."""

import glob
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prosarium.functions import metrics, prosody, ssml, text
from prosarium.operators import align, corpus, folds, intervals
from prosarium.plans import problems, reference

DATA = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_words_pauses_and_chunks(spark):
    iv = spark.createDataFrame([("v", 0, 0.0, 0.1, ""), ("v", 1, 0.1, 0.5, "bon"), ("v", 2, 0.5, 0.6, ""), ("v", 3, 0.6, 1.0, "jour."), ("v", 4, 1.0, 1.2, "")], "voice string, idx int, xmin double, xmax double, mark string")
    wp = intervals.words_and_pauses(iv, ["voice"])
    assert rows(wp.orderBy("idx").select("kind", "token", "dur_ms")) == [("word", "bon", 400), ("pause", None, 100), ("word", "jour.", 400), ("pause", None, 200)]
    sp = intervals.sentence_pauses(wp.select("voice", "idx", "kind", "token", "dur_ms"), ["voice"])
    ch = intervals.chunks(sp, ["voice"], ["idx", "sub"])
    assert rows(ch.orderBy("chunk_no").select("words", "start_ms", "end_ms", "pause_ms")) == [("bon", 0, 400, 0), ("", 400, 500, 100), ("jour.", 500, 900, 0), ("", 900, 1400, 500)]


def test_smoothing_golden(spark):
    df = spark.createDataFrame([("v", i, x) for i, x in enumerate([0.0, 100.0, -100.0, 50.0, 0.0])], "k string, i int, x double")
    ema = folds.exponential_average(df, ["k"], [F.col("i")], F.lit(0), "x", "s")
    lim = folds.limit_steps(ema, ["k"], [F.col("i")], F.lit(0), "s", "y")
    got = {r["i"]: (r["s"], r["y"]) for r in lim.collect()}
    assert np.allclose([got[i][0] for i in range(5)], [0, 20, -4, 6.8, 5.44]) and np.allclose([got[i][1] for i in range(5)], [0, 8, 0, 6.8, 5.44])


def test_smoothing_over_blocks_equals_one_pass(spark, monkeypatch):
    monkeypatch.setattr(folds, "BLOCK", 50)
    rng = random.Random(5)
    x = [rng.uniform(-40, 40) for _ in range(333)]
    df = spark.createDataFrame([("v", i, v) for i, v in enumerate(x)] + [("w", 0, 3.0), ("w", 1, None)], "k string, i int, x double")
    s, want = x[0], []
    for v in x:
        s = 0.2 * v + 0.8 * s
        want.append(s)
    got = {r["i"]: r["s"] for r in folds.exponential_average(df, ["k"], [F.col("i")], F.floor(F.col("i") / 64), "x", "s").where("k = 'v'").collect()}
    assert np.allclose([got[i] for i in range(333)], want, atol=1e-3)  # 0.8 ** 50 of older blocks is left out here
    got = {r["i"]: r["y"] for r in folds.limit_steps(df, ["k"], [F.col("i")], F.floor(F.col("i") / 64), "x", "y", 5.0).where("k = 'v'").collect()}
    assert np.allclose([got[i] for i in range(333)], folds.run_limit(x, 5.0))


def test_composed_limits_equal_runs():
    rng = random.Random(1)
    for _ in range(200):
        x, m = [rng.uniform(-50, 50) for _ in range(rng.randint(1, 40))], rng.choice([1, 5, 8, 20])
        xs, ys = folds.compose_limits(x, m)
        for s in (rng.uniform(-200, 200) for _ in range(10)):
            assert abs(folds.apply_line(xs, ys, s) - folds.run_limit(x, m, s)[-1]) < 1e-9


def test_prosody_golden(spark):
    one = spark.range(1)
    val = lambda c: one.select(c).first()[0]
    lit = F.lit
    for (p, b), w in {(200.0, 200.0): 0, (206.0, 200.0): 3.0, (400.0, 200.0): 7.798218, (100.0, 200.0): -5.120608, (0.0, 200.0): 0}.items():
        assert val(prosody.pitch_percent(lit(p), lit(b))) == pytest.approx(w, abs=1e-5)
    for (b, s), w in {(-20.0, -20.5): 5.925373, (-20.0, -25.0): 10, (-20.0, -10.0): -10}.items():
        assert val(prosody.volume_percent(lit(b), lit(s))) == pytest.approx(w, abs=1e-5)
    for (n, d, s), w in {(4, 0.8, 0.8): 0, (4, 2.0, 2.08): 0.828427, (4, 2.0, 1.98): -4.828427, (20, 6.0, 7.5): 0.206207, (20, 6.0, 5.0): -15, (0, 0.5, 0.5): 0}.items():
        assert val(prosody.rate_percent(lit(n), lit(d), lit(s))) == pytest.approx(w, abs=1e-5)
    assert val(prosody.damped_pitch(lit(16.0))) == 4 and val(prosody.damped_rate(lit(10.0))) == 2 and val(prosody.damped_rate(lit(-10.0))) == pytest.approx(-6.3096, abs=1e-4)
    assert val(ssml.signed(lit(2.675))) == "+2.67" and val(ssml.signed(lit(0.125))) == "+0.12"


def test_alignment_golden():
    assert align.global_pairs(list("ABC"), list("AC")) == [(0, 0), (1, -1), (2, 1)]
    assert align.global_pairs(["A"], ["B"]) == [(0, 0)] and align.global_pairs([], ["B"]) == [(-1, 0)] and align.global_pairs([], []) == []
    rng = random.Random(2)
    for _ in range(50):
        a, b = ([rng.choice("xyz") for _ in range(rng.randint(0, 9))] for _ in range(2))
        p = align.global_pairs(a, b)
        assert [i for i, _ in p if i >= 0] == list(range(len(a))) and [j for _, j in p if j >= 0] == list(range(len(b)))
    assert align.word_edits("le chat dort bien".split(), "le chien dort".split()) == 2
    assert align.break_hits([1, 2, 3], [1.2, 2.9, 3.2, 5]) == 2
    assert align.best_similarity_pairs(np.array([[1.0, 0.2], [0.1, 0.9]])) == [(0, 0), (1, 1)]
    tier = lambda *words: [{"mark": w, "xmin": float(i), "xmax": i + 1.0} for i, w in enumerate(words)]
    assert align.merge_tiers(tier("bon", "jour", "x"), tier("bonjour", "x")) == ([("bon jour", 0.0, 2.0), ("x", 2.0, 3.0)], [("bon jour", 0.0, 1.0), ("x", 1.0, 2.0)])
    assert align.merge_tiers(tier("a", "b", "c"), tier("abc")) == ([("a b c", 0.0, 3.0)], [("a b c", 0.0, 1.0)])
    assert align.merge_tiers(tier("", "bon", "jour"), tier("bonjour")) == ([(" ", 0.0, 1.0), ("bon jour", 1.0, 3.0)], [("bon jour", 0.0, 1.0)])
    assert align.merge_tiers(tier("a"), tier("a", "b", "c")) == ([("a", 0.0, 1.0)], [("a", 0.0, 1.0), ("b", 1.0, 2.0), ("c", 2.0, 3.0)])
    assert align.merge_tiers([], tier("a")) == ([], [("a", 0.0, 1.0)]) and align.merge_tiers([], []) == ([], [])
    assert align.greedy_text_pairs(["a b", "c"], ["c", "a b"]) == [(0, 1, 1.0), (1, 0, 1.0)]
    assert align.dtw_rmse(np.array([1.0, 2.0]), np.array([1.0, 1.0, 2.0])) == 0


def test_corpus_golden(spark):
    assert corpus.chunk_bounds([3, 2, 3], [True, False, False], 5) == [1, 3] and corpus.chunk_bounds([], [], 5) == []
    assert corpus.recover_json('<think>x</think>```json\n{"segments": [1,]}\n```') == '{"segments": [1]}' and corpus.recover_json(None) == '{"segments": []}' and corpus.recover_json('so: [{"a": 1}] ok') == '{"a": 1}'
    assert corpus.pack_segments([(1, 10.0), (2, 12.0), (3, 20.0), (7, 30.0)], 20, 4) == [([3], None), ([1, 2], None), ([7], 20)]
    assert corpus.respeed("<speak>a<break time='1ms'/>b</speak>", "+5%") == '<speak><prosody rate="+5%">a</prosody><break time="1ms"/><prosody rate="+5%">b</prosody></speak>'
    n = spark.range(37)
    s = {r["split"]: r["n"] for r in corpus.shuffled_split(n, "id", {"train": 0.8, "val": 0.1, "test": 0.1}).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert s == {"train": 29, "val": 3, "test": 5}
    assert corpus.bootstrap(n, "id", 3).count() == 111
    with pytest.raises(ValueError):
        corpus.checked_sample(n, "id", 50)


def test_metrics_golden(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.5), (4.0, 5.0)], "t double, p double")
    assert df.agg(metrics.r2(F.col("t"), F.col("p"))).first()[0] == pytest.approx(0.7)
    assert df.limit(1).agg(metrics.r2(F.col("t"), F.col("p"))).first()[0] is None


def test_joins_on_time_by_brute_force(spark):
    rng = random.Random(9)
    iv = lambda n: [(rng.choice("ab"), i, b, b + rng.choice([0.0, 1.0, 30.0, 100.0])) for i in range(n) for b in [rng.uniform(0, 200)]]
    left, right = iv(60), iv(60)
    a, b = spark.createDataFrame(left, "k string, i int, lb double, le double"), spark.createDataFrame(right, "k string, j int, rb double, re double")
    got = sorted((r["i"], r["j"]) for r in intervals.overlap_join(a, b, ["k"], "lb", "le", "rb", "re").collect())
    assert got == sorted((l[1], r[1]) for l in left for r in right if l[0] == r[0] and l[3] > l[2] and r[3] > r[2] and l[2] < r[3] and l[3] > r[2])
    words = spark.createDataFrame([("f", 0.5), ("f", 2.1), ("f", 3.0), ("f", None), ("g", 1.0)], "k string, at double")
    bounds = spark.createDataFrame([("f", 0.0, "1"), ("f", 2.0, "b"), ("f", 3.0, "2")], "k string, t double, label string")
    got = {(r["k"], r["at"]): r["label"] for r in intervals.asof_join(words, bounds, ["k"], "at", "t", "label").collect()}
    assert got == {("f", 0.5): "1", ("f", 2.1): "b", ("f", 3.0): "2", ("f", None): "unknown", ("g", 1.0): "unknown"}


def test_names_lines_and_tiers_golden(spark):
    names = {"qwen2.5:7b": "Qwen2.5 (7B)", "qwen": "Qwen", "deepseek-r1:8b": "Deepseek-R1 (8B)", "deepseek-coder": "Deepseek-Coder", "granite3.1": "Granite3 .1", "MISTRAL": "Mistral", "llama3:8b": "Llama3:8b"}
    df = spark.createDataFrame([(k,) for k in names], "m string")
    assert {r[0]: r[1] for r in df.select("m", text.model_label(F.col("m"))).collect()} == names
    shown = spark.createDataFrame([('<p rate="1%">a b</p><break time="5ms"/>',), (None,)], "s string").select(ssml.highlighted(F.col("s"))).collect()
    assert [r[0] for r in shown] == ['<p <span class="rate">rate="1%"</span>>\na b\n\n</p>\n<break <span class="break">time="5ms"</span>/>', None]
    ctm = spark.createDataFrame([("f", 0, 0.05, 0.5, "a"), ("f", 1, 0.6, 1.0, "b"), ("f", 2, 1.5, 2.0, "c")], "file string, i int, b double, e double, w string")
    got = [tuple(r) for r in intervals.ctm_intervals(ctm, ["file"], "b", "e", "w", "i").orderBy("i", "sub").select("xmin", "xmax", "mark").collect()]
    assert [(round(a, 3), round(b, 3), m) for a, b, m in got] == [(0.0, 0.45, "a"), (0.45, 0.85, "b"), (0.85, 1.35, ""), (1.35, 1.85, "c"), (1.85, 2.35, "")]
    plain = [tuple(r) for r in intervals.ctm_intervals(ctm, ["file"], "b", "e", "w", "i", close=False).orderBy("i", "sub").select("mark").collect()]
    assert [m for (m,) in plain] == ["", "a", "", "b", "", "c"]


def test_text_nulls_and_blanks(spark):
    df = spark.createDataFrame([(None,), ("",), ("  ",), ("Où, DES idées ;[*] x",)], "t string")
    for f in (text.fold_word, text.loose, text.clean_transcript, text.word_count, text.sentence_count, text.xml_escape, text.breath_hint, text.plain if hasattr(text, "plain") else text.squeeze, text.composed):
        assert len(df.select(f(F.col("t"))).collect()) == 4
    assert [r[0] for r in df.select(text.word_count(F.col("t"))).collect()] == [0, 0, 0, 5]


def value(v):
    if v is None or v != v:
        return "NULL"
    return f"{v:.6g}" if isinstance(v, float) else "[" + ",".join(map(str, v)) + "]" if isinstance(v, list) else str(v)


@pytest.fixture(scope="session")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test data here")
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


ALL, ALL_SQL = problems.QUERIES | reference.QUERIES, problems.SQL | reference.SQL


@pytest.mark.parametrize("name", sorted(ALL_SQL))
def test_query_equals_sql(spark, duck, name):
    df, rel = ALL[name](spark, DATA), duck.sql(ALL_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = [sorted(range(len(c)), key=c.__getitem__) for c in (df.columns, rel.columns)]
    got, want = (sorted(tuple(value(r[i]) for i in o) for r in rows) for rows, o in zip((df.collect(), rel.fetchall()), order))
    assert got == want


@pytest.mark.parametrize("name", sorted(set(ALL) - set(ALL_SQL)))
def test_query_without_sql_runs(spark, duck, name):
    assert ALL[name](spark, DATA).count() >= 0
