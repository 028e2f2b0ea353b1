"""Every read query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from cytoplan.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def canonical(rows):
    fix = lambda v: ("nan" if math.isnan(v) else float(f"{v:.9g}")) if isinstance(v, float) else v
    return sorted((tuple(map(fix, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    other = duck.sql(SQL[name])
    assert sorted(other.columns) == cols
    at = [other.columns.index(c) for c in cols]
    assert canonical(df.select(*cols).collect()) == canonical([tuple(r[i] for i in at) for r in other.fetchall()])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["b4_unique_plan", "u2_winner_take_all", "u12_parsimony", "u17_parsimony_em", "e6_bootstrap"])
def test_partition_count_does_not_matter(spark, name):
    was, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append(canonical(QUERIES[name](spark, SF).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert seen[0] == seen[1]


@pytest.mark.parametrize("name", ["k8_resolved_lists", "u5_small_cells"])
@pytest.mark.parametrize("sizes", [(2, 3), (3, 4), (4, 5, 4, 5), ()])
def test_a_mean_of_a_half_is_rounded_as_in_the_sql(spark, tmp_path, name, sizes):
    """Cells of as many reads as the mean without its half: their reads share an identifier and have different genes."""
    rows = [(cell, 4 * i, 1, 1, 1.0, "N", "O") for cell, n in enumerate(sizes) for i in range(n)]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    c = duckdb.connect()
    c.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    df, other = QUERIES[name](spark, str(tmp_path)), c.sql(SQL[name])
    at = [other.columns.index(x) for x in df.columns]
    assert canonical(df.collect()) == canonical([tuple(r[i] for i in at) for r in other.fetchall()])
