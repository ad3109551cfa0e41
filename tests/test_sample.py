from pyspark.sql import functions as F

from millrace.operators import features, sample


def test_negatives_are_new_and_distinct(spark):
    rows = [(i, "abc"[i % 3], "xy"[i % 2], str(i % 5)) for i in range(12)]
    df = spark.createDataFrame(rows, "id int, p string, q string, r string")
    out = sample.synthetic_negatives(df, "id", ["p", "q", "r"], ["q", "r"]).collect()
    made = [(r.p, r.q, r.r) for r in out]
    assert made and len(set(made)) == len(made) and not set(made) & {r[1:] for r in rows}
    assert all(dict((r[0], r[1]) for r in rows)[r.id] == r.p for r in out)
    again = sample.synthetic_negatives(df.repartition(7), "id", ["p", "q", "r"], ["q", "r"]).collect()
    assert sorted(out) == sorted(again)


def test_drops_and_donors(spark):
    df = spark.range(20).withColumn("g", F.col("id") % 2)
    kept = sample.drop_random(df, F.col("g") == 1, 4, 7, "id")
    assert kept.count() == 16 and kept.filter("g = 0").count() == 10
    near = sample.nearest_donors(df, ["g"], F.abs(F.col("id") - 9), "id", 2)
    assert sorted(r.id for r in near.collect()) == [7, 8, 9, 10]


def test_feature_vectors(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), (None, 3.0)], "t string, n double")
    rows = features.feature_vectors(df, ["t"], ["n"]).collect()
    assert [len(r.features) for r in rows] == [5, 5, 5]
    assert [r.features[4] for r in rows] == [0.0, 1.0, 0.0]
