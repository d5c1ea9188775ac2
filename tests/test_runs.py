import time

import pytest
from pyspark.sql import functions as F

from postlake.operators import index, runs


def slow(spark, seconds=0.05, rows=400):
    wait = F.udf(lambda x: time.sleep(seconds) or x, "long")
    return spark.range(0, rows, 1, 40).select(wait("id").alias("id"))


def test_progress_and_result(spark):
    seen = []
    assert runs.watched(spark, lambda: slow(spark, 0.02).agg(F.sum("id")).first()[0], "sum", seen.append, every=0.1) == sum(range(400))
    assert seen and seen[-1].tasks >= 40 and [p.done for p in seen] == sorted(p.done for p in seen) and seen[-1].jobs >= 1
    with pytest.raises(ZeroDivisionError):
        runs.watched(spark, lambda: 1 // 0, "fails", seen.append)


def test_a_cancelled_run_stops_and_the_index_goes_on(spark, tmp_path):
    idx = index.Index(spark, f"file://{tmp_path}/idx")
    rows = spark.range(60).selectExpr("id as nid", "'a' as source_name", "'f' as folder", "concat('s', id) as subject", "'x' as sender", "cast(null as timestamp) as date", "1L as size", "'' as to", "concat('word', id) as body")
    prints = rows.groupBy("source_name").agg(F.sum("size").alias("size"), F.lit(1.0).alias("mtime"))
    idx.update(rows.where("nid < 20"), prints)
    texts = lambda new: rows.join(slow(spark, 1.0, 60).withColumnRenamed("id", "nid"), "nid").join(new.select("nid"), "nid", "left_semi")
    run = runs.Run(spark, lambda: idx.update(rows.drop("body"), prints, texts=texts), "index")
    deadline = time.time() + 60
    while run.progress().jobs < 4 and time.time() < deadline:
        time.sleep(0.1)
    run.cancel()
    with pytest.raises(runs.Cancelled):
        run.result()
    assert idx.messages().count() == 20 and idx.search("word5").count() == 1 and idx.search("word50").count() == 0
    assert idx.update(rows, prints) == {"added": 40, "kept": 20, "removed": 0} and idx.search("word50").count() == 1
    assert slow(spark, 0, 10).count() == 10  # later jobs aren't of the group
