"""Views that a query reads once are not kept, so the columns nobody reads are not shuffled."""

from pyspark.sql import functions as F

from checks import views


def test_views_read_once_are_pruned(spark, tmp_path):
    spark.range(20).selectExpr(
        "id AS p_partkey", "CAST(id AS INT) AS p_size", "'Brand#13' AS p_brand", "'TYPE' AS p_type", "concat('a b', id) AS p_name"
    ).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(60).selectExpr(
        "id AS l_orderkey", "id % 20 AS l_partkey", "CAST(1 AS INT) AS l_linenumber", "id AS l_suppkey", "0.04D AS l_tax", "0.02D AS l_discount",
        "CAST(id % 7 AS DOUBLE) AS l_quantity", "1D AS l_extendedprice", "date'2024-01-01' AS l_shipdate", "'R' AS l_returnflag"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    t = views.Tables(spark, str(tmp_path))
    once = t.plain("fx_invariants").groupBy("source_kind").agg(F.count("*").alias("n"))
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert "source_location" not in plan and "confidence" not in plan
    built = {k[2] for k in views._BUILT if k[1] == str(tmp_path)}
    assert "fx_invariants" not in built and "fx_candidates" not in built
    kept = t.invariants.groupBy("source_kind").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, kept.collect())) == [("test", 60)]
