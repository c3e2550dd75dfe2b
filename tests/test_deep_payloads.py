"""Payloads that are nested deeper than Python's calls may go."""

import json
import random

import pytest

from prosarium.operators import nested


@pytest.mark.parametrize("depth", [600, 2000, 20_000])
def test_deep_members_lose_no_rows(spark, depth):
    deep = '{"x": ' * depth + "1" + "}" * depth
    text = f'{{"pitch_adjustments": [1, 2], "parsed_sequence": [{{"text": "a", "segment": "s"}}, {{"deep": {deep}}}], "extra": {deep}, "break_times": [3]}}'
    df = spark.createDataFrame([(1, text), (2, text[:-1]), (3, '{"break_times": [4]}')], "record_id long, payload string")
    bridge = nested.unpack_payloads(df, "record_id", "payload").cache()
    got = [tuple(r) for r in bridge.where("child is not null").select("record_id", "child", "segment", "pos", "parent_id", "child_id").collect()]
    assert sorted(r[:4] for r in got) == [(1, "break_times", "", 0), (1, "pitch_adjustments", "", 0), (1, "pitch_adjustments", "", 1), (1, "sequence", "", 1), (1, "sequence", "s", 0), (3, "break_times", "", 0)]
    assert all(r[4] and r[5] for r in got)
    # The record, its lists and values, two elements, and both chains of objects to their ends.
    assert bridge.where("record_id = 1").count() == 1 + 3 + 3 + 2 + 2 * depth
    assert bridge.where("kind = 'unreadable'").select("record_id").collect() == [(2,)]


def value(rng, depth=0):
    kind = rng.choice("odlsnbz" if depth < 4 else "snbz")
    if kind in "od":
        return {rng.choice("abcé\"") + str(k): value(rng, depth + 1) for k in range(rng.randint(0, 4))}
    if kind == "l":
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return {"s": rng.choice(["", "é\\n\"", "[1"]), "n": rng.choice([0, -3, 2.5, 1e30]), "b": True, "z": None}[kind]


def recursive(x):
    if isinstance(x, dict):
        return nested._sha(",".join(["o", *sorted(f"{len(k)}:{k}={recursive(v)}" for k, v in x.items() if v is not None)]))
    return nested._sha(",".join(["l", *(recursive(v) for v in x if v is not None)])) if isinstance(x, list) else nested._leaf(x)


def test_reading_writing_and_identities_equal_the_recursive_ones(monkeypatch):
    rng = random.Random(7)
    for _ in range(400):
        v = value(rng)
        text = json.dumps(v, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        assert nested._read_deep(text) == v and nested.graph({"x": v})[0].own == recursive({"x": v})
        cut = list(text)
        cut[rng.randrange(len(cut))] = rng.choice(["", ",", "]", "}", '"', "x", ":"])
        cut = "".join(cut)
        try:
            want = json.loads(cut, parse_constant=nested._no_constant)
        except ValueError:
            with pytest.raises(ValueError):
                nested._read_deep(cut)
        else:
            assert nested._read_deep(cut) == want
    values = [value(rng) for _ in range(200)]
    want = [json.dumps(v, ensure_ascii=False, sort_keys=s) for v in values for s in (False, True)]
    dumps = json.dumps

    def shallow(x, **how):
        if isinstance(x, (dict, list)):
            raise RecursionError
        return dumps(x, **how)

    monkeypatch.setattr(nested.json, "dumps", shallow)
    assert [nested._written(v, s) for v in values for s in (False, True)] == want
