import glob
import os
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vetta.operators import features, scorer
from vetta.sources import segments, sinks, views


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="vetta-test-", dir="/tmp")


def _segment_rows(spark):
    return spark.createDataFrame(
        [("r1", 1, " a b ", "x", "en", "de", "S1", 70.0), ("r2", 1, "c", "y y", "en", "zh", "S2", 40.0),
         ("r3", 2, "nan", "z", "en", "de", "S1", 10.0), ("r4", 2, "d", None, "en", "de", "S2", 90.0)],
        "row_id string, doc_id long, src_text string, tgt_text string, src_lang string, tgt_lang string, "
        "tgt_system string, score double")


def test_multi_part_read_split_and_missing(spark, scratch):
    df = _segment_rows(spark)
    df.filter("doc_id = 1").write.parquet(f"{scratch}/dev-00000-of-00002.parquet")
    df.filter("doc_id = 2").write.parquet(f"{scratch}/dev-00001-of-00002.parquet")
    paths = [f"{scratch}/dev-00000-of-00002.parquet", f"{scratch}/dev-00001-of-00002.parquet",
             f"{scratch}/dev-00002-of-00002.parquet"]
    seg = segments.read_segments(spark, paths, ["doc_id", "score", "audio_path"])
    assert seg.columns == ["doc_id", "score"] and seg.count() == 4


def test_split_from_file_name(spark, scratch):
    _segment_rows(spark).coalesce(1).write.parquet(f"{scratch}/tbl")
    src = glob.glob(f"{scratch}/tbl/*.parquet")[0]
    dst = f"{scratch}/dev-00000-of-00003.parquet"
    with open(src, "rb") as a, open(dst, "wb") as b:
        b.write(a.read())
    got = segments.with_split(spark.read.parquet(dst)).select("split").distinct().collect()
    assert [r.split for r in got] == ["dev"]


def test_load_test_set_and_peek(spark, scratch):
    df = _segment_rows(spark)
    df.write.parquet(f"{scratch}/dev")
    df.drop("tgt_text").write.parquet(f"{scratch}/bad")
    t = segments.load_test_set(spark, {"dev": f"{scratch}/dev"})
    assert t.count() == 4
    with pytest.raises(ValueError):
        segments.load_test_set(spark, {"test": f"{scratch}/bad", "dev": f"{scratch}/dev"})
    first, types = segments.peek(t)
    assert first is not None and ("score", "double") in types


def test_signal_columns_and_weights(spark):
    cols = ["score", "a_score", "b_score", "sonar_cosine", "metricx_error"]
    assert segments.signal_columns(cols) == ["a_score", "b_score"]
    assert segments.signal_columns(cols, fixed=["b_score", "sonar_cosine", "zz"]) == ["b_score", "sonar_cosine"]
    saved = spark.createDataFrame([("a_score", 0.7)], "signal string, weight double")
    w = {r.signal: r.weight for r in segments.weights_with_default(["a_score", "b_score"], saved).collect()}
    assert w == {"a_score": 0.7, "b_score": 0.5}


def test_side_features_inner_and_coverage(spark):
    df = _segment_rows(spark)
    side = spark.createDataFrame([("r1", 1.0), ("r3", 3.0), ("zz", 9.0)], "row_id string, f double")
    left, cov = segments.attach_side_features(df, side, prefix="speech_")
    c = cov.first()
    assert (c.rows, c.matched, c.unmatched) == (4, 2, 2)
    inner, _ = segments.attach_side_features(df, side, how="inner")
    assert sorted(r.row_id for r in inner.collect()) == ["r1", "r3"]


def test_training_csv_and_parquet_roundtrip(spark, scratch):
    df = _segment_rows(spark)
    sinks.write_training_csv(df, f"{scratch}/csv", with_system=True)
    back = spark.read.option("header", True).csv(f"{scratch}/csv")
    rows = {r.src: r for r in back.collect()}
    assert set(rows) == {"a b", "c"}                # 'nan' and null text dropped, text stripped
    assert float(rows["a b"].score) == pytest.approx(0.7) and rows["c"].system == "S2"
    v = spark.createDataFrame([(1, [0.5, 1.5])], "vec_id long, embedding array<float>")
    sinks.write_parquet(v, f"{scratch}/emb")
    assert spark.read.parquet(f"{scratch}/emb").first().embedding == [0.5, 1.5]


def test_score_file_is_ordered(spark, scratch):
    df = spark.range(5000).select(F.format_string("%06d", "id").alias("seq"),
                                  (F.col("id") / 7.0).alias("v")).repartition(9)
    sinks.write_score_file(df, "v", "seq", f"{scratch}/scores")
    lines = []
    for f in sorted(glob.glob(f"{scratch}/scores/part-*")):
        with open(f) as fh:
            lines += fh.read().splitlines()
    assert lines == [f"{i / 7.0:.6f}" for i in range(5000)]


def test_fixed6_matches_python():
    vals = pd.Series([0.2187245, 1 / 3, 2.5e-7, -0.0000005, 123456.7890125, None])
    got = sinks.fixed6.func(vals)
    for v, g in zip(vals, got):
        assert (g is None) if pd.isna(v) else g == f"{v:.6f}"


def test_cap_frames_and_speech_rate(spark):
    df = spark.createDataFrame([(16000 * 40, 16000, "a b c d"), (800, 16000, "one two")],
                               "frames long, sample_rate int, src_text string")
    r = features.speech_rate(df).withColumn("capped", features.cap_frames("frames", 30.0)).collect()
    assert r[0].capped == 16000 * 30 and r[0].audio_duration == 40.0
    assert r[1].words_per_sec == pytest.approx(2 / 0.1)          # duration floored at 0.1 s


def test_score_with_batches_and_groups(spark):
    df = _segment_rows(spark).withColumn("lp", F.concat_ws("-", "src_lang", "tgt_lang"))

    def make():
        def fn(pdf):
            assert pdf["lp"].nunique() == 1                    # uniform batches per group
            return np.full(len(pdf), float(len(pdf)))
        return fn
    out = {r.row_id: r.s for r in scorer.score_with(df, make, ["src_text", "tgt_text"], "s",
                                                    batch_size=2, group_by="lp").collect()}
    assert set(out) == {"r1", "r2", "r3", "r4"} and max(out.values()) <= 2.0
    merged, checks = scorer.merge_signal(df, spark.createDataFrame([("r1", 1.0)], "row_id string, s double"))
    c = checks.first()
    assert (c.rows, c.matched, c.key_unique) == (4, 1, True)


def test_fixture_views_smoke(spark, sf_dir):
    assert views.segments(spark, sf_dir).count() > 0
    sp = views.spans(spark, sf_dir)
    assert sp.filter(F.size("spans") == 0).count() > 0      # orders without lines
    um = views.user_matrix(spark, sf_dir)
    assert um.filter(F.col("sig_k_score").isNull()).count() == 0


def test_mixed_schema_parts(spark, scratch):
    a = spark.createDataFrame([(1, 0.5)], "doc_id long, score double")
    b = spark.createDataFrame([(2, 0.7, "S1")], "doc_id long, score double, tgt_system string")
    a.write.parquet(f"{scratch}/p0")
    b.write.parquet(f"{scratch}/p1")
    seg = segments.read_segments(spark, [f"{scratch}/p0", f"{scratch}/p1"],
                                 ["doc_id", "score", "tgt_system"], merge_schema=True)
    got = sorted((r.doc_id, r.tgt_system) for r in seg.collect())
    assert seg.columns == ["doc_id", "score", "tgt_system"] and got == [(1, None), (2, "S1")]


def test_a_frequent_value_is_scored_by_many_tasks(spark):
    rows = [(f"r{i}", "hot" if i % 10 else f"v{i % 7}") for i in range(4000)]
    df = spark.createDataFrame(rows, "row_id string, lp string")

    def make():
        from pyspark import TaskContext

        def fn(pdf):
            assert pdf["lp"].nunique() == 1
            return [float(TaskContext.get().partitionId())] * len(pdf)
        return fn

    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = scorer.score_with(df, make, [], "task", group_by="lp").groupBy("task").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    sizes = sorted(r["count"] for r in out)
    assert sum(sizes) == 4000 and len(sizes) >= 4 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
