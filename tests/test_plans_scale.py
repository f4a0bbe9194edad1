from pyspark.sql import functions as F

from caliper.session import bounded_broadcast


def test_bounded_broadcast_checks_size(spark):
    small = spark.range(10).withColumnRenamed("id", "k")
    big = spark.range(1000).withColumnRenamed("id", "k")
    fact = spark.range(5000).withColumn("k", F.col("id") % 100)
    plan_small = fact.join(bounded_broadcast(small, 100), "k")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan_small
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan_big = fact.join(bounded_broadcast(big, 100), "k")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan_big
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))


def _executed(df):
    """Run the plan and return its final (adaptive) text."""
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan()
    list(df.toLocalIterator())
    return plan.toString()


TINY = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.coalescePartitions.enabled": "false"}


class _Conf:
    def __init__(self, spark, conf):
        self.spark, self.conf = spark, conf

    def __enter__(self):
        self.old = {k: self.spark.conf.get(k, None) for k in self.conf}
        for k, v in self.conf.items():
            self.spark.conf.set(k, v)

    def __exit__(self, *_):
        for k, v in self.old.items():
            self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)


def _written(df):
    from caliper.session import cut_lineage
    return cut_lineage(df)


def test_hot_and_null_fact_keys_are_split(spark):
    from caliper.operators.enrich import child_counts, left_join_null_safe
    fact = spark.range(40_000).select(F.col("id").alias("row"), F.when(F.col("id") % 5 > 0, None).otherwise(F.when(
        F.col("id") % 10 == 0, 7).otherwise(F.col("id"))).alias("k"), F.repeat(F.lit("x"), 40).alias("pad"))
    fact = _written(fact.repartition(6))
    child = spark.range(3000).select(F.when(F.col("id") < 100, None).otherwise(F.col("id") % 50).alias("k"))
    with _Conf(spark, TINY):
        joined = left_join_null_safe(fact, child_counts(child, "k", "n", for_join=True), "k")
        assert joined.filter("k is null and n = 100").count() == 32_000 and joined.filter("k = 7 and n = 58").count() == 4000
        assert joined.count() == 40_000
        assert "skew=true" in _executed(joined)


def test_date_keys_join_null_safe(spark):
    from caliper.operators.enrich import child_counts, left_join_null_safe
    fact = spark.sql("select * from values (date'2024-01-01', 1), (null, 2), (date'2024-01-02', 3) as t(d, row)")
    child = spark.sql("select * from values (date'2024-01-01'), (null), (null) as t(d)")
    got = {r.row: r.n for r in left_join_null_safe(fact, child_counts(child, "d", "n", for_join=True), "d").collect()}
    assert got == {1: 1, 2: 2, 3: None}


def test_duplicate_overlap_dedups_before_the_exchange_and_splits_a_hot_test_row(spark):
    from caliper.operators.quality import duplicate_overlap
    train = _written(spark.range(30_000).select(F.when(F.col("id") % 4 > 0, 1).otherwise(F.col("id")).alias("x"), F.lit("a").alias("y")))
    test = _written(spark.range(30_000).select(F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") + 100_000).alias("x"), F.lit("a").alias("y"),
                                               F.repeat(F.lit("p"), 60).alias("pad")).repartition(6))
    with _Conf(spark, TINY):
        out = duplicate_overlap(train, test, ["x", "y"])
        assert out.count() == 20_000
        plan = _executed(out)
        assert "skew=true" in plan
        under = plan[plan.index("Aggregate"):]
        assert under.count("Aggregate") >= 2  # partial below the exchange, final above


def test_ranges_stay_balanced_with_outliers_and_concentration(spark):
    from caliper.operators.quantiles import exact_quantiles, ordered_sums
    values = spark.range(20_000).select((F.col("id") / 1e6).alias("x")).unionByName(spark.sql("select 1e12D as x"))
    with _Conf(spark, {"spark.sql.shuffle.partitions": "8"}):
        per = values.groupBy("x").agg(F.count("*").alias("n"))
        ranked = ordered_sums(per, "x", ["n"])
        assert ranked.filter("n_before > 19999").count() == 1 and ranked.agg(F.max("n_total")).first()[0] == 20_001
        plan = ranked._jdf.queryExecution().executedPlan().toString()
        assert "__range" in plan
        sizes = [r["c"] for r in spark.read.parquet(*ranked.inputFiles()).groupBy("__range").agg(F.count("*").alias("c")).collect()]
        assert len(sizes) == 8 and max(sizes) < 3 * 20_001 / 8
    hot = values.unionByName(spark.range(60_000).select(F.lit(0.5).alias("x")))
    got = {r.fraction: r.value for r in exact_quantiles(hot, "x", [0.0, 0.5, 1.0]).collect()}
    assert got == {0.0: 0.0, 0.5: 0.5, 1.0: 1e12}


def test_nothing_stays_persisted(spark):
    import __spark_entry__ as E
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    for name in ("match_rates", "leakage_report", "calibration_bins"):
        E.queries()[name](spark, "/root/testdata/sf0.001").collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_a_cluster_without_a_shared_folder_is_refused():
    from caliper.session import ensure_checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    try:
        ensure_checkpoint_dir(Session())
    except RuntimeError as e:
        assert "spark.checkpoint.dir" in str(e)
    else:
        raise AssertionError("a cluster without a shared folder must be refused")
