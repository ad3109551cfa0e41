import random

import duckdb
import pytest

from millrace import catalog
from millrace.plans import curation

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    return f"{v:.9g}" if isinstance(v, float) and v == v else ("" if v is None or v != v else str(v))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in columns) for r in df.toPandas().to_dict("records"))
    sql = catalog.oracle_sql().get(name)
    if sql:
        want = duck.execute(sql).df()
        assert sorted(want.columns) == columns
        assert got == sorted(tuple(cell(r[c]) for c in columns) for r in want.to_dict("records"))


def test_hamming_nearest_takes_every_part(spark, tmp_path):
    draw = random.Random(3)
    rows = [(k, draw.choice("abcdef"), draw.choice("uvwxyz"), draw.randrange(9)) for k in (*range(1, 40), *range(390, 460), 5000, 5001)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = {r.p_partkey: (r.distance, r.nearest) for r in catalog.queries()["hamming_nearest"](spark, str(tmp_path)).collect()}
    odd = [r for r in rows if r[0] % 2]
    assert got == {a[0]: min((sum(x != y for x, y in zip(a[1:], b[1:], strict=True)), b[0]) for b in odd) for a in rows if a[0] % 2 == 0}


def test_cluster_holdout_takes_the_real_clusters(spark):
    rows = curation.cleaned(spark, FOLDER)
    got = {r.split: r for r in catalog.queries()["cluster_holdout_search"](spark, FOLDER).collect()}
    k = rows.select("cluster_key").distinct().count()
    assert k > 200 and sum(r.n_clusters for r in got.values()) == k and got["holdout"].n_clusters == round(0.1 * k)
    assert sum(r.n_rows for r in got.values()) == rows.count() and 0.09 < got["holdout"].n_rows / rows.count() < 0.11


@pytest.mark.parametrize("rows", [[], [(i, i % 2) for i in range(5000)], [(97 * i, 1) for i in range(50)] + [(1, 0), (3, 0)], [(97, 1)] * 30 + [(None, 1), (2, None), (97, None)]], ids=["none", "many", "few", "repeated"])
def test_sample_to_label_counts_takes_any_size(spark, tmp_path, rows):
    spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = catalog.queries()["sample_to_label_counts"](spark, str(tmp_path)).collect()
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW labels AS SELECT * FROM '{tmp_path}/labels.parquet/*.parquet'")
        want = c.execute(catalog.oracle_sql()["sample_to_label_counts"]).fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
