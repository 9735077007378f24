"""Joins of the checks are broadcast by measured size alone."""

from repolens import session


def test_no_join_is_broadcast_on_an_estimate(spark, tmp_path):
    from pyspark.sql import functions as F

    from checks.views import Tables

    # rows that are far larger than the file they come from
    spark.range(3000).select(
        F.col("id").alias("p_partkey"), F.lit("a b c").alias("p_name"), F.lit("Brand#11").alias("p_brand"), F.lit("X Y").alias("p_type"),
        (F.col("id") % 50).cast("int").alias("p_size")).write.parquet(str(tmp_path / "part.parquet"))
    before = {k: spark.conf.get(k, None) for k in session.MEASURED_JOINS}
    for key in before:
        spark.conf.unset(key)
    try:
        t = Tables(spark, str(tmp_path))
        wide = t.symbols.select("repo_hash", "symbol_id", F.explode(F.sequence(F.lit(1), F.lit(500))).alias("n"))
        joined = t.symbols.join(wide, ["repo_hash", "symbol_id"])
        assert "BroadcastExchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 3000 * 500
    finally:
        for key, value in before.items():
            if value is not None:
                spark.conf.set(key, value)
