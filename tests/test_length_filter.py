"""P10 and P11 on odd white space, types and nulls: golden rows, and the SQL on random records around the limit."""

import random

import duckdb
import pytest

from prosarium.plans import reference

NAME = "s_p10_p11_filters"
SCHEMA = "record_id long, voice string, parsed_sequence array<struct<segment:string,type:string,text:string,time:string,prosody:struct<pitch:string,rate:string,volume:string>>>"


def element(kind, text=None):
    return ("s", kind, text, None, None)


def words(n, between=" "):
    return between.join(["mot"] * n)


#: Sequence, short, has_break. 123 words of x and y together are the most that are short (159.9 < 160).
GOLDEN = [
    ([element("text", words(61)), element("break")], True, True),
    ([element("text", words(62)), element("break")], False, True),
    ([element("text", words(60) + " deux\u00a0mots"), element("break")], True, True),
    ([element("text", words(60) + " fin\u202f!"), element("break")], True, True),
    ([element("text", words(61, "\t\n")), element("break")], True, True),
    ([element("text", words(62, "\r\x0b\x0c")), element("break")], False, True),
    ([element("text", words(61)), element("text", "\u00a0"), element("text", " \u3000\u2003 "), element("break")], True, True),
    ([element("text", words(61)), element("text", "\t"), element("break")], True, True),
    ([element("text", words(60) + " a \u00a0 b"), element("break")], False, True),
    ([element(" Text\u00a0", words(62)), element("\u202fBREAK ")], False, True),
    ([element("text", "\u00a0"), element(None, words(99)), None], True, False),
    ([element("audio", words(99)), element("text", None)], True, False),
]


def written(spark, tmp_path, sequences):
    data = [(k, "v", s) for k, s in enumerate(sequences)]
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{tmp_path}/corpus.parquet")
    return str(tmp_path)


def of_spark(spark, folder):
    return {r["record_id"]: (r["short"], r["has_break"]) for r in reference.QUERIES[NAME](spark, folder).collect()}


def of_sql(folder):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW corpus AS SELECT * FROM '{folder}/corpus.parquet/*.parquet'")
    return {k: (short, has_break) for k, short, has_break in con.sql(f"SELECT record_id, short, has_break FROM ({reference.SQL[NAME]})").fetchall()}


def test_length_filter_golden(spark, tmp_path):
    folder = written(spark, tmp_path, [s for s, _, _ in GOLDEN] + [[], None, [None]])
    want = {k: (short, has_break) for k, (_, short, has_break) in enumerate(GOLDEN)}
    assert of_sql(folder) == want
    assert of_spark(spark, folder) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_length_filter_equals_sql_around_the_limit(spark, tmp_path, seed):
    rng = random.Random(seed)
    spaces = [" ", "  ", "\u00a0", "\u202f", "\u3000", "\u2003", "\u2028", "\x1c", "\x85", "\t", "\n", "\r\n", "\x0b", "\u200b", " \u00a0 "]
    part = lambda: "".join(rng.choice([*spaces, "mot", "mot", "<break/>"]) for _ in range(rng.randint(0, 6)))
    kinds = ["text", "text", "text", "Text ", "break", "\u00a0BREAK", "break\u202f", "text\t", "audio", None]
    sequences = []
    for _ in range(800):
        s = [rng.choice([element(rng.choice(kinds), part()), element(rng.choice(kinds)), None]) for _ in range(rng.randint(0, 5))]
        sequences.append([*s, element("text", words(rng.randint(54, 62)))] if rng.random() < 0.9 else s)
    folder = written(spark, tmp_path, sequences)
    want = of_sql(folder)
    assert {short for short, _ in want.values()} == {True, False}
    assert of_spark(spark, folder) == want
