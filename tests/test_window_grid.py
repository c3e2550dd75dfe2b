"""Window grids over whole segments."""

from prosarium.plans import reference


def test_grid_reaches_the_last_usable_end(spark, tmp_path):
    ends = [("a", "s1", 3.0), ("a", "s1", 2500.7), ("a", "s1", float("nan")), ("a", "s2", 0.4), ("a", "s3", None), ("b", "s1", 15.0), ("b", "s1", -4.0), ("b", "s2", float("inf")), ("b", "s2", 31.25)]
    spark.createDataFrame(ends, "voice string, segment string, end_syntagme_natural double").write.parquet(f"{tmp_path}/bdd_syntagme_ssml.parquet")
    got = sorted(map(tuple, reference.QUERIES["i13_window_grid"](spark, str(tmp_path)).collect()))
    grid = lambda v, s, d: [(v, s, w, min(w + 15.0, d)) for w in range(0, int(d), 15)]
    assert got == grid("a", "s1", 2500.7) + grid("b", "s1", 15.0) + grid("b", "s2", 31.25) and len(got) == 171
