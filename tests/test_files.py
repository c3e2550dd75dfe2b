"""Readers and writers on small files, audio, providers and streams."""

import json
import math
import struct
import wave

import numpy as np
from pyspark.sql import functions as F

from prosarium import external
from prosarium.sources import audio, readers, writers
from prosarium.streaming import sessions


def test_textgrid_files(spark, tmp_path):
    iv = spark.createDataFrame([("f", 0, 0.0, 0.5, 'a "b"'), ("f", 1, 0.5, 1.0, ""), ("f", 2, 1.0, 1.5, "C [x], d")], "stem string, idx int, xmin double, xmax double, mark string")
    grid = writers.textgrid(iv, ["stem"]).first()["value"]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "f.TextGrid").write_text(grid)
    got = [tuple(r) for r in readers.read_textgrids(spark, str(tmp_path), "Words").orderBy("idx").select("stem", "idx", "xmin", "xmax", "mark").collect()]
    assert got == [tuple(r) for r in iv.orderBy("idx").collect()]
    assert spark.createDataFrame([(grid,)], "v string").select(readers.textgrid_text(F.col("v"))).first()[0].endswith("C  d")
    assert readers.gold_intervals(iv, lower=True).count() == 2


def test_text_files(spark, tmp_path):
    (tmp_path / "seg_2.txt").write_text("1: a (0.0-1.0, 1.0) || 1: b (0.0-1.0, 1.0)\nbroken line\n")
    got = readers.read_alignments(spark, str(tmp_path)).collect()
    assert len(got) == 1 and got[0]["file_no"] == 2 and got[0]["natural"].startswith("1: b")
    (tmp_path / "x.ctm").write_text("f 1 0.10 0.25 bon<space> NA lex NA\nshort\n")
    assert [tuple(r)[2:] for r in readers.read_entries(spark, str(tmp_path / "x.ctm"), readers.ctm_entry).collect()] == [("f", 0.1, 0.25, "bon ")]
    (tmp_path / "l.lex").write_text("Bon b ON\n\nseul\n")
    assert [r["phones"] for r in readers.read_entries(spark, str(tmp_path / "l.lex"), readers.lexicon_entry).collect()] == ["b ON"]


def test_json_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"x": "1"}, {"x": "2"}]))
    (tmp_path / "b.json").write_text(json.dumps({"x": "3"}))
    (tmp_path / "c.json").write_text("{broken")
    assert sorted(r["x"] for r in readers.read_json_folder(spark, str(tmp_path), "x string").collect() if r["x"]) == ["1", "2", "3"]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "t.json").write_text(json.dumps({"text": "a b", "segments": [{"id": 0, "text": " a", "words": [{"start": 0.0, "end": 1.0, "text": "a", "confidence": 0.5}]}]}))
    t = readers.read_transcripts(spark, str(tmp_path / "w"))
    assert t.first()["joined"] == "a" and readers.transcript_words(t).count() == 1


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("p1", 0.0, 1.0, 1.0, 'x, "y"\nz'), ("p2", None, None, None, "12")], readers.schemas.SEGMENTS)
    writers.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(str, readers.read_table_csv(spark, str(tmp_path / "c")).collect())) == sorted(map(str, df.collect()))


def make_wav(path, x, rate=8000):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(b"".join(struct.pack("<h", int(v * 32767)) for v in x))


def test_audio(spark, tmp_path):
    tone = [0.5 * math.sin(2 * math.pi * 200 * i / 8000) for i in range(8000)]
    make_wav(tmp_path / "a.wav", tone + [0.0] * 12000 + tone)
    (tmp_path / "bad.wav").write_bytes(b"RIFFxxxx")
    df = audio.read_wavs(spark, str(tmp_path))
    row = df.first()
    assert df.count() == 1 and row["seconds"] == 3.5
    parts = [(round(r["begin"], 1), round(r["end"], 1)) for r in audio.silence_split(df).orderBy("segment").collect()]
    assert parts == [(0.0, 1.3), (2.2, 3.5)]
    assert audio.silent_islands(np.zeros(0), 8000) == [] and len(audio.spectrogram(np.array(tone))) > 50
    assert df.select(F.size(audio.slice_samples(F.col("samples"), F.col("rate"), F.lit(0.5), F.lit(0.75)))).first()[0] == 2000
    assert abs(external.stub_pitch(np.array(tone), 8000) - 200) < 3 and external.stub_pitch(np.zeros(10), 8000) == 0


def test_providers(spark):
    df = spark.createDataFrame([("bon",), (None,), ("",)], "w string")
    assert [r[0] for r in df.select(external.provided(external.stub_phones, F.col("w"))).collect()] == ["b o n", None, ""]


def test_rendering(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "k string, v double")
    assert writers.render(df).count("\n") == 3 and "tabular" in writers.render(df, "latex") and "<td>a</td>" in writers.render_html(df)


def test_streams(spark, tmp_path):
    data = spark.createDataFrame([("u", f"2024-01-01 00:00:{s:02d}", float(s)) for s in (0, 1, 2, 30, 31)] + [("u", "2024-01-02 00:00:00", 1.0)], "k string, t string, v double").withColumn("t", F.col("t").cast("timestamp"))
    data.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    sessions.run_to_table(sessions.gap_sessions_stream(stream, "k", "t", "5 seconds"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [2, 3]
