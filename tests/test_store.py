"""The posting table in buckets: pruned reads, compaction, retries, filters."""

import pytest
from pyspark.sql import functions as F

from postlens.operators.postings import KEY
from postlens.sources import store as B
from postlens.tables import work_dir

SCHEMA = "company_id bigint, content_hash string, seq bigint"


def rows(spark, *pairs):
    return spark.createDataFrame([(c, h, i) for i, (c, h) in enumerate(pairs)], SCHEMA)


def live(spark, root, **given):
    return sorted((r.company_id, r.content_hash, r.batch_id) for r in B.read_store(spark, root, "postings", SCHEMA, **given).collect())


def test_batches_retries_and_compaction(spark):
    root = work_dir(spark, "store")
    assert live(spark, root) == [] and B.compacted(spark, root, "postings") == (0, -1)
    B.write_batch(rows(spark, (1, "lost")), root, "postings", 0)
    B.write_batch(rows(spark, (1, "a"), (2, "b")), root, "postings", 0)          # the retry replaces the lost try
    B.write_batch(rows(spark), root, "postings", 1)
    B.write_batch(rows(spark, (1, "c")), root, "postings", 2)
    every = [(1, "a", 0), (1, "c", 2), (2, "b", 0)]
    assert live(spark, root) == every and live(spark, root, before=2) == [every[0], every[2]]
    # a lost compaction left a folder, which nobody reads and the next one replaces
    B.write_batch(rows(spark, (7, "half")), root, "postings", 2, gen=1)
    assert live(spark, root) == every
    B.compact(spark, root, "postings", SCHEMA, 2)
    B.compact(spark, root, "postings", SCHEMA, 2)
    B.write_batch(rows(spark, (3, "d")), root, "postings", 3)
    assert live(spark, root) == [(1, "a", 2), (1, "c", 2), (2, "b", 2), (3, "d", 3)]
    B.compact(spark, root, "postings", SCHEMA, 3)
    assert B.compacted(spark, root, "postings") == (2, 3)
    assert [r[:2] for r in live(spark, root)] == [(1, "a"), (1, "c"), (2, "b"), (3, "d")]


def test_a_batch_reads_its_buckets_only(spark):
    root = work_dir(spark, "store")
    B.write_batch(rows(spark, *[(c, f"h{k}") for c in range(60) for k in range(5)]), root, "postings", 0)
    batch = rows(spark, (3, "h1"), (3, "new"), (4, "h9"))
    found = B.stored_keys(batch, root, "postings", 1, list(KEY))
    assert {tuple(r) for r in found.collect()} >= {(3, "h1")} and found.count() <= 10
    plan = found._jdf.queryExecution().executedPlan().toString()
    few = set(f.split("bucket=")[1].split("/")[0] for f in B.read_store(spark, root, "postings", SCHEMA, buckets=[
        r[0] for r in batch.select(B.bucket_of()).distinct().collect()
    ]).select(F.input_file_name()).distinct().toPandas().iloc[:, 0])
    assert "PartitionFilters" in plan and 0 < len(few) <= 2
    assert B.stored_keys(batch.limit(0), root, "postings", 1, list(KEY)).count() == 0


def test_key_filter_loses_no_key(spark):
    many = spark.range(20_000).select(F.col("id").alias("company_id"), F.concat(F.lit("h"), "id").alias("content_hash"))
    batch = many.where("company_id % 97 = 0")
    kept = B.may_hold(many, batch, list(KEY))
    assert batch.exceptAll(kept).isEmpty() and kept.count() < 1.2 * batch.count()


def test_rows_with_a_key_of_their_own_stay(spark):
    """F7, F8: of a batch only rows whose key is stored, or there twice, are compared by key."""
    from postlens.operators.common import apart_by_key

    batch = spark.createDataFrame([(1, f"k{i % 990}", i) for i in range(1_000)], "company_id bigint, content_hash string, seq bigint")
    stored = spark.createDataFrame([(1, f"k{i}") for i in range(500, 520)] + [(2, "k1")], "company_id bigint, content_hash string")
    alone, again = (sorted(r.content_hash for r in part.collect()) for part in apart_by_key(batch, KEY, stored))
    sure = [f"k{i % 990}" for i in range(1_000) if i % 990 < 10 or 500 <= i < 520]
    assert sorted(alone + again) == sorted(f"k{i % 990}" for i in range(1_000)) and not set(alone) & set(sure)
    assert len(sure) <= len(again) < 50


def test_a_table_for_a_block_leaves_nothing(spark):
    import os

    from postlens.tables import written_for

    with pytest.raises(ZeroDivisionError), written_for(spark.range(5).toDF("n"), "block") as table:
        folder = table.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert table.count() == 5 and os.path.exists(folder)
        1 / 0
    assert not os.path.exists(folder)
