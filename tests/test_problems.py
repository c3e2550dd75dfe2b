"""The data-preparation operators of the core against brute force, and on the cases that break things."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prosarium.operators import impute, nested, periods, ranking, spikes


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# Intervals


def brute_periods(intervals, tolerance=10):
    out = []
    for key in {i[0] for i in intervals}:
        mine = sorted((b, e) for k, b, e in intervals if k == key)
        begin, end = mine[0]
        for b, e in mine[1:]:
            if b - end > tolerance:
                out += [(key, "period", begin, end), (key, "gap", end, b)]
                begin, end = b, e
            else:
                end = max(end, e)
        out.append((key, "period", begin, end))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard", [7, 50, 600_000])
def test_periods_match_brute_force_for_any_shard(spark, shard):
    rng = random.Random(shard)
    data = [(k, b, b + rng.choice([0, 3, 10, 11, 40, 200])) for k in ("a", "b", None) for b in (rng.randrange(-300, 900) for _ in range(25))]
    df = spark.createDataFrame(data, "k string, b long, e long")
    assert rows(periods.periods_and_gaps(df, ["k"], "b", "e", shard=shard)) == brute_periods(data)


def test_periods_edges(spark):
    df = spark.createDataFrame([("a", 0, 5, "x"), ("a", 0, 5, "x"), ("a", 16, 16, "y"), ("a", 15, 15, None), ("b", None, 3, "z"), ("b", 3, None, "z")], "at string, b long, e long, shard string")
    assert rows(periods.periods_and_gaps(df, ["at"], "b", "e")) == [("a", "period", 0, 16)]
    df = spark.createDataFrame([("a", 0, 5), ("a", 16, 20)], "kind string, b long, e long").withColumnRenamed("kind", "starts")
    assert rows(periods.periods_and_gaps(df, ["starts"], "b", "e")) == [("a", "gap", 5, 16), ("a", "period", 0, 5), ("a", "period", 16, 20)]
    assert rows(periods.periods_and_gaps(df.limit(0), ["starts"], "b", "e")) == []


def test_mended_intervals(spark):
    nan = float("nan")
    data = [(1, 1.0, 2.0, None), (2, None, 2.0, 0.5), (3, 1.0, nan, 0.5), (4, nan, None, 3.0), (5, 3.0, 1.0, None), (6, 1.0, None, 9999.0), (7, 1.0, None, -1.0), (8, 0.0, 0.0, 0.0)]
    df = periods.mend_intervals(spark.createDataFrame(data, "i int, b double, e double, d double"), "b", "e", "d")
    assert rows(df.select("i", "b_ms", "e_ms")) == [(1, 1000, 2000), (2, 1500, 2000), (3, 1000, 1500), (5, 1000, 3000), (8, 0, 0)]


def test_spoken_knows_unicode_white_space(spark):
    df = spark.createDataFrame([(" ",), ("  　",), ("",), (None,), ("​",), (" a ",)], "t string")
    assert [r[0] for r in df.select(periods.spoken(F.col("t"))).collect()] == [False, False, False, False, True, True]


# Spikes


def test_faults_of_a_moving_source_over_many_blocks(spark):
    rng = np.random.default_rng(3)
    n = 9000
    x = 200 + np.arange(n) * 0.01 + np.clip(rng.normal(0, 2, n), -7.5, 7.5)
    spiked = rng.choice(n, 60, replace=False)
    x[spiked] += rng.choice([-1, 1], 60) * rng.uniform(14, 60, 60)
    x[4090:4100] = 240.125  # across a border of blocks of 2048
    x[17], x[18], x[19] = -3, 1500, 0
    stuck = set(range(4090, 4100))
    want = {(int(i), "spike") for i in spiked if i not in stuck and i not in (17, 18, 19)} | {(i, "stuck") for i in stuck} | {(17, "impossible"), (18, "impossible")}
    data = [("v", i, float(v), 1) for i, v in enumerate(x)] + [("v", 18, 1500.0, 2), ("w", 0, 5.0, 1), ("w", 1, None, 1), ("w", 2, float("nan"), 1)]
    df = spark.createDataFrame(data, "voice string, i int, f double, kind int")
    got = spikes.faulty_readings(df, "voice", ["i"], [F.col("i")], F.floor(F.col("i") / 512), {"f": (0.0, 1000.0)})
    assert {(r["i"], r["kind"]) for r in got.collect() if r["voice"] == "v"} == want
    assert got.where("voice = 'w'").count() == 0


def test_phase_space_decides_what_is_a_spike(spark, monkeypatch):
    """Neighbours of spikes are outside every plane, too, and a value's size alone doesn't tell: without the ellipsoids rows differ."""
    rng = np.random.default_rng(11)
    u = np.clip(rng.normal(0, 1, 3000), -4, 4)
    at = np.arange(50, 2950, 97)
    u[at] = rng.choice([-1, 1], len(at)) * rng.uniform(8, 30, len(at))
    u[[500, 501, 502]] = 12.0, 14.0, 9.0  # a cluster
    u[700], u[702] = 20.0, -25.0
    want = set(at.tolist()) | {500, 501, 502, 700, 702}
    assert set(np.flatnonzero(spikes.phase_space(u, 6.0)).tolist()) == want
    points = spikes.phase_points(u)
    inside = spikes._ordinary(u, np.zeros(3000, bool))
    outside = spikes._squared_radius(points, spikes._products(points, inside), int(inside.sum())) > 36
    assert set(np.flatnonzero(outside).tolist()) > want | {501, 701, 703}  # one look, without setting spikes to the level
    df = spark.createDataFrame([("v", i, float(x) + 300) for i, x in enumerate(u)], "voice string, i int, f double")
    run = lambda: {r["i"] for r in spikes.faulty_readings(df, "voice", ["i"], [F.col("i")], F.floor(F.col("i") / 512), {"f": (0.0, 1000.0)}).collect()}
    assert run() == want
    # A whole, not a part, of the result comes through the ellipsoids.
    monkeypatch.setattr(spikes, "phase_space", lambda u, radius=None: np.zeros(len(u), bool))
    blocks = spikes._inspect({"f": (0.0, 1000.0)}, ["f"], 6)
    import pyarrow as pa

    table = pa.table({"place": pa.array([{"i": i} for i in range(3000)]), "pos": np.arange(3000), "value": u + 300})
    assert blocks((pa.scalar("v"), pa.scalar(0), pa.scalar(0)), table)["kind"].to_pylist() == [-1]


def test_faults_of_rounded_constant_and_empty_sources(spark):
    data = [("a", i, 5.0 if i % 2 else 6.0) for i in range(40)] + [("b", i, 7.0) for i in range(5)] + [(None, i, 7.0) for i in range(6)]
    df = spark.createDataFrame(data, "s string, i int, f double")
    run = lambda d: spikes.faulty_readings(d, "s", ["i"], [F.col("i")], F.lit(0), {"f": (0.0, 1000.0)})
    assert rows(run(df).select("s", "i", "kind")) == sorted([(None, i, "stuck") for i in range(6)], key=str)
    assert run(df.limit(0)).count() == 0


# Imputation


def test_imputation_marks_fills_and_repeats(spark):
    rng = random.Random(1)
    data = []
    for i in range(3000):
        g = rng.choice(["p", "q", None])
        base = {"p": 0.0, "q": 1.0, None: 0.4}[g] + rng.gauss(0, 0.3)
        a, b = np.exp(base + rng.gauss(0, 0.05)), np.exp(base + 0.2 + rng.gauss(0, 0.05))
        data.append((i, g, float(a), float(b), f"fr-{g}", base))
    hidden = {}
    out = []
    for i, g, a, b, c, base in data:
        if i % 9 == 0:
            hidden[i, "a"], a = a, rng.choice([None, float("nan"), -1.0, 0.0, 9999.0])
        if i % 11 == 0:
            hidden[i, "b"], b = b, None
        if i % 13 == 0:
            hidden[i, "c"], c = c, rng.choice([None, "", "N/A"])
        out.append((i, g, a, b, c, i % 50 != 0))
    df = spark.createDataFrame(out, "id long, g string, a double, b double, c string, spoken boolean").withColumn("number", F.lit(1))
    run = lambda: impute.chained_impute(df, "id", "g", [impute.Numeric("a", 0, 600), impute.Numeric("b", 0, 600)], [impute.Categorical("c", "^fr-")], where=F.col("spoken"))
    got = {(r["id"], r["field_name"]): (r["number"], r["category"]) for r in run().collect()}
    assert set(got) == {k for k in hidden if k[1] == "c" or k[0] % 50 != 0}
    errors = [abs(np.log(got[k][0] / v)) for k, v in hidden.items() if k in got and k[1] != "c"]
    assert np.mean(errors) < 0.12  # the group mean alone would miss by 0.24
    assert all(got[k][1] == v for k, v in hidden.items() if k[1] == "c" and v != "fr-None")
    assert got == {(r["id"], r["field_name"]): (r["number"], r["category"]) for r in run().collect()}


def test_imputation_without_usable_values_and_empty(spark):
    df = spark.createDataFrame([(1, "g", None, None), (2, "g", -1.0, "x")], "id long, g string, a double, c string")
    run = lambda d: impute.chained_impute(d, "id", "g", [impute.Numeric("a", 0, 600)], [impute.Categorical("c", "^fr-")])
    assert run(df).count() == 0
    assert run(df.limit(0)).count() == 0


# Nested records

PAYLOADS = [
    None, "", "   ", "{", '{"a": NaN}', "[]", "3",
    '{"y": {"parsed_sequence": {"segment": 7, "type": "text"}}}',
    '{"y": "{\\"parsed_sequence\\": [[{\\"segment\\": \\"s\\"}], null, {\\"segment\\": null}, 5], \\"stripped_ssml\\": {\\"s\\": \\"<a>\\", \\"t\\": [null, \\"b\\", [\\"c\\"]]}}"}',
    '[{"runs": [{"metrics": {"break_times": 5, "pitch_adjustments": [1.5, null, "2", [3]]}}]}, {"metrics": {"break_times": [7, 8]}, "parsed_sequence": null, "stripped_ssml": null}]',
    '{"x": "[not json", "metrics": "{\\"rate_adjustments\\": [1e-7]}", "\\ud800": "\\ud800"}',
]


def test_payload_children(spark):
    df = spark.createDataFrame(list(enumerate(PAYLOADS)), "raw_id int, payload string").withColumn("child", F.lit("clash"))
    bridge = nested.unpack_payloads(df, "raw_id", "payload")
    assert [r[0] for r in rows(bridge.where("kind = 'unreadable'").select("record_id"))] == [2, 3, 4]
    got = rows(bridge.where("child is not null").select("record_id", "child", "segment", "pos", "value"))
    assert [r[:4] for r in got] == sorted(
        [(7, "sequence", "7", 0), (8, "sequence", "s", 0), (8, "sequence", "", 1), (8, "stripped", "s", 0), (8, "stripped", "t", 0), (8, "stripped", "t", 1)]
        + [(9, "break_times", "", 0), (9, "break_times", "", 1), (9, "break_times", "", 2), *((9, "pitch_adjustments", "", i) for i in range(3)), (10, "rate_adjustments", "", 0)],
        key=str,
    )


def test_identities_are_the_same_in_columns_and_text(spark):
    kind = "id int, parsed_sequence array<struct<segment:string,type:string,text:string,time:string,prosody:struct<pitch:string,rate:string,volume:string>>>, stripped_ssml map<string,array<string>>, metrics struct<break_times:array<int>,pitch_adjustments:array<double>>"
    element = ("s1", "text", "é\n", None, ("+1%", None, "x"))
    data = [(1, [element, None, element], {"s1": ["a", None, "b"], "s2": None}, ([5, None], [1.5, -0.25, 1e-7, 12345678.0])), (2, None, None, None), (3, [], {}, (None, []))]
    df = spark.createDataFrame(data, kind)
    typed = nested.unpack_columns(df, "id", "parsed_sequence", "stripped_ssml", "metrics")
    text = nested.unpack_payloads(df.select("id", F.to_json(F.struct("parsed_sequence", "stripped_ssml", "metrics"), {"ignoreNullFields": "false"}).alias("p")), "id", "p")
    pick = ("record_id", "parent_id", "name", "ordinal", "child_id", "kind", "child", "segment", "pos")
    assert rows(typed.select(*pick)) == rows(text.select(*pick))
    assert typed.where("child is not null").count() == 2 + 2 + 1 + 4
    element_id = typed.where("child = 'sequence'").first()["child_id"]
    store = nested.object_store(typed).where(F.col("child_id") == element_id).collect()
    assert len(store) == 1 and store[0]["occurrences"] == 2
    assert rebuilt(typed, 1) == {
        "parsed_sequence": [{"segment": "s1", "type": "text", "text": "é\n", "prosody": {"pitch": "+1%", "volume": "x"}}] * 2,
        "stripped_ssml": {"s1": ["a", "b"]},
        "metrics": {"break_times": ["5"], "pitch_adjustments": ["1.5", "-0.25", "1.0E-7", "1.2345678E7"]},
    }
    assert rebuilt(typed, 2) == {}


def rebuilt(bridge, record):
    """A record put together from the store and the bridge rows alone."""
    store = {r["child_id"]: r for r in nested.object_store(bridge).collect()}
    edges, top = {}, None
    for r in bridge.where(F.col("record_id") == record).collect():
        if r["parent_id"] is None:
            top = r["child_id"]
        else:
            assert r["parent_id"] in store, "dangling parent"
            edges.setdefault(r["parent_id"], set()).add((r["ordinal"], r["name"], r["child_id"]))

    def build(i):
        kind, value, members = store[i]["kind"], store[i]["value"], edges.get(i, ())
        if kind == "value":
            return value
        if kind == "list":
            return [build(c) for _, _, c in sorted(members)]
        return json.loads(value) | {name: build(c) for _, name, c in members}

    return build(top)


def canonical(x, held=False):
    """A payload as store and bridge hold it: without nulls, with strings that hold JSON opened where children are looked for, list values as text."""
    if isinstance(x, dict):
        return {k: canonical(v, held) if isinstance(v, (dict, list)) else v for k, v in x.items() if v is not None}
    if isinstance(x, list):
        return [canonical(v) if isinstance(v, (dict, list)) else v if isinstance(v, str) else json.dumps(v) for v in x if v is not None]
    return x


def test_records_are_whole_in_store_and_bridge(spark):
    rng = random.Random(5)

    def made(depth=0):
        kind = rng.choice("ooll" if depth < 2 else "ol" if depth < 4 else "v") if rng.random() < 0.7 else "v"
        if kind == "o":
            return {rng.choice(["a", "b=c,", "k:1", "é"]) + str(i): made(depth + 1) for i in range(rng.randint(0, 4))}
        if kind == "l":
            return [made(depth + 1) for _ in range(rng.randint(0, 4))]
        return rng.choice(["", "x", "=,", 5, -2.5, True, None, 10**20])

    data = [(i, {"extra": made(), "parsed_sequence": [{"segment": "s", "text": "t", "more": made()}, None], "stripped_ssml": {"s": ["a", None], "=": []}}) for i in range(12)]
    bridge = nested.unpack_payloads(spark.createDataFrame([(i, json.dumps(v)) for i, v in data], "id long, p string"), "id", "p").cache()
    for i, v in data:
        assert rebuilt(bridge, i) == canonical(v)
    stored = nested.object_store(bridge)
    assert bridge.where("parent_id is not null").join(stored.select(F.col("child_id").alias("parent_id")), "parent_id", "left_anti").count() == 0
    assert stored.agg(F.sum("occurrences")).first()[0] == bridge.count()


def test_identities_know_equal_numbers_and_no_forged_keys():
    own = lambda text: nested.graph(json.loads(text))[0].own
    assert own('{"a": 5}') == own('{"a": 5.0}') == own('{"a": 5e0, "b": null}') != own('{"a": "5"}')
    assert own("[1e300, 0.1, -0.0]") == own("[1.0e+300, 0.10, 0]") != own("[1e300, 0.1]")
    assert len({own(t) for t in ("[9007199254740993]", "[9007199254740992]", '["9007199254740992"]', "[[9007199254740992]]", "[true]", '["true"]', "[1]")}) == 7
    inner = nested.graph({"x": 1})[0].own
    assert own('{"a": {"x": 1}, "b": 2}') != own(json.dumps({f"a={inner},b": 2})) != own(json.dumps({f"a={inner},1:b": 2}))


def test_deep_and_empty_records(spark):
    deep = "[" * 3000 + "]" * 3000
    df = spark.createDataFrame([(1, deep), (2, json.dumps({"metrics": {"break_times": list(range(5000))}}))], "id int, p string")
    assert nested.unpack_payloads(df, "id", "p").where("child is not null").count() == 5000
    assert nested.unpack_payloads(df.limit(0), "id", "p").count() == 0


# Ranking


def test_row_numbers_and_windows_across_shards_and_blocks(spark):
    data = [(k, i) for k in ("a", None) for i in range(57)]
    df = spark.createDataFrame(data, "k string, i int")
    got = ranking.sharded_row_number(df, ["k"], F.floor(F.col("i") / 10), [F.col("i")], "n")
    assert all(r["n"] == r["i"] for r in got.collect())
    sums = ranking.windowed_in_blocks(df, ["k"], F.floor(F.col("i") / 10), [F.col("i")], 3, 2, lambda w: {"s": F.sum("i").over(w)}, block=8)
    assert {(r["k"], r["i"]): r["s"] for r in sums.collect()} == {(k, i): sum(range(max(0, i - 3), min(57, i + 3))) for k, i in data}


def test_joins_with_null_and_skewed_keys(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2), ("a", 3), ("z", 4)], "k string, i int")
    right = spark.createDataFrame([(None, "n"), ("a", "x")], "k string, v string")
    assert rows(ranking.salted_join(left, right, "k", F.col("i"), 4)) == [("a", 2, "x"), ("a", 3, "x"), ("z", 4, None), (None, 1, "n")]
    assert rows(ranking.null_safe_join(left, right, ["k"], "left_anti")) == [("z", 4)]
