from pyspark.sql import functions as F

from veilscribe.operators import diagnostics as D
from veilscribe.operators import selection as S


def test_budget_keeps_the_row_that_crosses(spark):
    rows = spark.range(200).select(F.col("id").alias("k"), F.lit(10.0).alias("duration_sec"))
    assert S.duration_budget(rows, target_sec=95.0, most_items=99, key="k").count() == 10
    assert S.duration_budget(rows, target_sec=1e9, most_items=7, key="k").count() == 7
    assert S.duration_budget(rows.limit(0), target_sec=5.0, most_items=7, key="k").count() == 0


def test_numbers_are_consecutive(spark):
    rows = spark.range(1000).select(F.col("id"), F.md5(F.col("id").cast("string")).alias("h"))
    got = S.numbered(rows, ["h"], "n", start=5).orderBy("h").collect()
    assert [r["n"] for r in got] == list(range(5, 1005))
    assert S.numbered(rows.limit(0), ["h"], "n").count() == 0


def test_folds(spark):
    dealt = S.folds(spark.range(11).withColumnRenamed("id", "k"), 3, key="k")
    train, held = S.fold_split(dealt, 1)
    assert sorted(r["n"] for r in dealt.groupBy("fold").agg(F.count("*").alias("n")).collect()) == [3, 4, 4] and train.count() + held.count() == 11


def test_resumption(spark):
    inputs = spark.createDataFrame([("a",), ("b",), ("c",)], "item_id string")
    done = spark.createDataFrame([("a", "seg_000007"), ("a", "seg_000003"), (None, "x")], "source_item_id string, segment_id string")
    assert sorted(r[0] for r in S.unprocessed(inputs, done).collect()) == ["b", "c"]
    assert [r[0] for r in S.already_processed(inputs, done).collect()] == ["a"]
    assert done.agg(S.last_segment_number(done)).first()[0] == 7


def test_exclusion(spark):
    manifest = spark.createDataFrame([("u1", "x_y_z"), ("", "a_b_u2"), (None, "short")], "utt_id string, item_id string")
    ids = spark.createDataFrame([(" u3 ",), ("",)], "utt_id string")
    got = S.excluded_ids(manifest, ids)
    assert sorted(r[0] for r in got.collect()) == ["u1", "u2", "u3"]
    rows = spark.createDataFrame([("u1",), ("u4",), (None,)], "utt_id string")
    assert sorted(map(str, (r[0] for r in S.without(rows, got, "utt_id").collect()))) == ["None", "u4"]


def test_nearest_falls_back(spark):
    rows = spark.createDataFrame([("a", 0.05), ("b", 0.5), ("c", 0.52), ("d", 0.9)], "item_id string, wer double")
    got = S.nearest(rows, "wer", 0.0, 0.2, 2, "item_id", 0.51).collect()
    assert sorted(r["item_id"] for r in got) == ["b", "c"] and got[0]["selection"] == "fallback_near_median"


def test_percentiles_interpolate(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "v double")
    r = D.distribution(rows, "v").first()
    assert (round(r["p90"], 9), r["median"], r["n"]) == (7.9, 2.5, 4)


def test_histogram_closes_the_last_bin(spark):
    rows = spark.createDataFrame([(0.0,), (0.2,), (1.0,), (1.1,), (None,)], "v double")
    assert [(r["label"], r["n"]) for r in D.histogram(rows, "v", [0.0, 0.2, 1.0]).orderBy("bin").collect()] == [("[0.0, 0.2)", 1), ("[0.2, 1.0]", 2)]


def test_flat_columns_have_no_correlation(spark):
    rows = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, None, 5.0)], "x double, y double, z double")
    assert rows.agg(D.correlation("x", "y"), D.correlation("x", "z")).first() == (1.0, None)


def test_drop_reasons(spark):
    rows = spark.createDataFrame([(" ", 1.0), ("x" * 501, 1.0), ("x", 31.0), ("x", 30.0), (None, None)], "transcript string, duration_sec double")
    assert [r["drop_reason"] for r in D.drop_reasons(rows).collect()] == ["empty", "long_chars", "long_audio", None, "empty"]
