"""Stored tables: freed with their last reader, made again when the data change."""

import gc
import os
import time

from energraph import runtime as rt


def tables(spark):
    where = rt.shared_dir(spark).removeprefix("file:")
    return set(os.listdir(where)) if os.path.exists(where) else set()


def swept(spark, own):
    for _ in range(20):
        gc.collect()
        rt.sweep(spark, collect=True)
        if not tables(spark) & own:
            return True
        time.sleep(0.3)
    return False


def test_a_table_lives_as_long_as_a_plan_reads_it(spark):
    before = tables(spark)
    df = rt.settle(spark.range(100).selectExpr("id", "id % 7 AS k"))
    own = tables(spark) - before
    late = df.groupBy("k").count()
    del df
    assert len(own) == 1 and not swept(spark, own) and late.count() == 7
    del late
    assert swept(spark, own)


def test_nothing_is_left_of_a_run(spark):
    from energraph.operators.propagate import propagate

    before = tables(spark)
    adj = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "src string, dst string, w double")
    run = propagate(adj, spark.createDataFrame([("q", "a", 1.0)], "qid string, node string, weight double"))
    own = tables(spark) - before
    assert {r.node for r in run.activations.collect()} == {"a", "b"} and own
    del run
    assert swept(spark, own) and not [t for t in spark.catalog.listTables() if t.name.startswith("energraph_")]


def test_rewritten_tables_give_new_results(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    made = []

    def read():
        return rt.kept(spark, str(tmp_path), ["t"], ("rows",), lambda: made.append(1) or rt.settle(spark.read.parquet(path))).count()

    spark.range(3).write.parquet(path)
    assert read() == read() == 3 and len(made) == 1
    time.sleep(0.01)
    spark.range(5).write.mode("overwrite").parquet(path)
    assert read() == 5 and len(made) == 2
    rt.forget()
