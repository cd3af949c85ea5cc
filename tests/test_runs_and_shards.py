"""Replayed archives, expiry, bucket merges, resumed shards and run counts as a stream."""

import json
from collections import Counter
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rolesift.operators import shards as SH
from rolesift.session import matching_folders, path_exists
from rolesift.sources import archive as A
from rolesift.sources.specs import SPECS, normalize_source
from rolesift.streaming import ingest as ST

RAW = "source string, run_ts timestamp, payload string"


def bag(df):
    return Counter(tuple(r) for r in df.select("source", "run_ts", "payload").collect())


def test_a_replayed_run_leaves_the_archive_as_it_was(spark, tmp_path):
    root = str(tmp_path / "raw")
    day = datetime(2026, 4, 1)
    first = [("a", day, f"p{i}") for i in range(20)] + [("b", day, "q"), (None, None, "r")]
    later = [("a", day + timedelta(hours=3), "other run of the day")]
    A.replace_runs(spark.createDataFrame(first, RAW), root)
    A.replace_runs(spark.createDataFrame(later, RAW), root)
    before = bag(A.read_runs(spark, root))
    assert before == Counter(first + later)
    A.replace_runs(spark.createDataFrame(first, RAW), root)
    assert bag(A.read_runs(spark, root)) == before
    A.replace_runs(spark.createDataFrame([("a", day, "new content")], RAW), root)
    assert bag(A.read_runs(spark, root)) == Counter([("a", day, "new content"), *first[20:], *later])
    got = A.read_runs(spark, root, ["b"], F.lit(day))
    assert bag(got) == Counter(first[20:21])


def test_expiry_deletes_whole_directories(spark, tmp_path):
    root = str(tmp_path / "raw")
    days = [datetime(2026, 1, 1) + timedelta(days=i) for i in range(6)]
    rows = [("a", d, "x") for d in days] + [("b", days[0], "x"), (None, None, "undated")]
    A.replace_runs(spark.createDataFrame(rows, RAW), root)
    gone = A.drop_expired(spark, root, date(2026, 1, 13), 10)
    assert len(gone) == 4                                   # the first three days, one of them of b
    left = [r["run_ts"] for r in A.read_runs(spark, root).collect()]
    assert sorted(t for t in left if t) == days[3:] and left.count(None) == 1
    assert A.drop_expired(spark, root, date(2026, 1, 13), 10) == []


def landing(spark, root, *ids, title="VP"):
    rows = [("remoteok", datetime(2026, 4, 20), json.dumps(
        {"id": i, "title": title, "company": "A"})) for i in ids]
    spark.createDataFrame(rows, ST.LANDED).coalesce(1).write.mode("append").json(f"{root}/landed")


def drain(spark, root):
    def normalize(batch):
        return normalize_source(batch, SPECS["remoteok"], F.lit(datetime(2026, 4, 20)))
    ST.stream_merge(ST.read_landed(spark, f"{root}/landed"), normalize, f"{root}/t",
                    f"{root}/progress", buckets=16).awaitTermination()
    return {r["job_id"]: r["title"] for r in ST.read_merged(spark, f"{root}/t").collect()}


def files_of(spark, root):
    return {f.rsplit("/", 1)[0]: f for f in spark.read.parquet(f"{root}/t/table").inputFiles()}


def test_a_batch_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    root = str(tmp_path)
    landing(spark, root, *range(40))
    assert len(drain(spark, root)) == 40
    before = files_of(spark, root)
    landing(spark, root, 3, title="CTO")
    assert drain(spark, root)["remoteok:3"] == "CTO"
    after = files_of(spark, root)
    assert before.keys() == after.keys() and sum(before[k] != after[k] for k in before) == 1
    assert drain(spark, root)["remoteok:3"] == "CTO" and files_of(spark, root) == after
    assert not matching_folders(spark, f"{root}/t/_merging*")


def test_merging_the_same_postings_again_changes_nothing(spark, tmp_path):
    rows = normalize_source(spark.createDataFrame(
        [(json.dumps({"id": i % 7, "title": "VP", "company": "A"}),) for i in range(20)],
        "payload string"), SPECS["remoteok"], F.lit(datetime(2026, 4, 20)))
    for _ in range(2):
        ST.merge_into_buckets(rows, str(tmp_path), buckets=4)
    assert ST.read_merged(spark, str(tmp_path)).count() == 7
    ST.merge_into_buckets(rows.limit(0), str(tmp_path / "none"))
    assert not path_exists(spark, str(tmp_path / "none"))


@pytest.fixture
def postings(spark):
    return spark.range(200).select(F.concat(F.lit("j"), "id").alias("job_id"), "id").unionByName(
        spark.createDataFrame([(None, 1), (None, 2), ("j1", 3)], "job_id string, id long"))


def doubled(rows):
    return rows.withColumn("twice", F.col("id") * 2)


def test_a_resumed_pass_equals_an_uninterrupted_one(spark, postings, tmp_path):
    root = str(tmp_path)
    SH.write_shards(postings, root, 5)
    assert SH.finished(spark, root).count() == 0
    first = SH.run_shards(spark, root, doubled, stop_after=2)

    def failing(rows):
        if rows.where("id % 2 = 1").count():
            raise RuntimeError("lost")
        return rows

    with pytest.raises(RuntimeError):
        SH.run_shards(spark, root, failing)
    # What a broken attempt left behind is neither read nor kept.
    left = SH.unfinished(spark, root)[0]
    spark.range(9).withColumn("job_id", F.lit("x")).write.parquet(f"{root}/output/shard={left}")
    assert SH.read_finished(spark, root).count() == sum(
        r["rows"] for r in SH.finished(spark, root).collect())
    rest = SH.run_shards(spark, root, doubled)
    assert sorted(first + rest) == list(range(5)) and SH.run_shards(spark, root, doubled) == []
    got = Counter(tuple(r) for r in SH.read_finished(spark, root).collect())
    assert got == Counter(tuple(r) for r in doubled(postings).collect())


def test_a_shard_reads_its_own_directory(spark, postings, tmp_path):
    SH.write_shards(postings, str(tmp_path), 5)
    seen = []
    SH.run_shards(spark, str(tmp_path), lambda rows: seen.append(
        rows._jdf.queryExecution().executedPlan().toString()) or rows)
    assert all("PartitionFilters: [isnotnull(shard" in p for p in seen) and len(seen) == 5


def test_a_shard_joins_its_own_part_of_a_table_beside(spark, postings, tmp_path):
    root, seen = str(tmp_path), []
    other = spark.range(100).select(F.concat(F.lit("j"), "id").alias("job_id"), (-F.col("id")).alias("n"))
    SH.write_shards(postings, root, 4)
    SH.write_shards(other, root, 4, "other")

    def work(rows, beside):
        seen.append(beside.count())
        return rows.join(beside, "job_id", "left")

    SH.run_shards(spark, root, work, beside=("other",))
    assert sum(seen) == 100 and max(seen) < 100
    got = Counter(tuple(r) for r in SH.read_finished(spark, root).select("job_id", "id", "n").collect())
    assert got == Counter(tuple(r) for r in postings.join(other, "job_id", "left")
                          .select("job_id", "id", "n").collect())


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    rows = normalize_source(spark.range(0, 4000, 1, 8).select(F.to_json(F.struct(
        "id", F.sha2(F.col("id").cast("string"), 512).alias("title"), F.lit("A").alias("company")))
        .alias("payload")), SPECS["remoteok"], F.lit(datetime(2026, 4, 20)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ST.merge_into_buckets(rows, str(tmp_path), buckets=1)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spark.read.parquet(f"{tmp_path}/table").inputFiles()) > 1
    assert ST.read_merged(spark, str(tmp_path)).select("job_id").distinct().count() == 4000


RUNS = "source_name string, run_timestamp timestamp, jobs_new int, jobs_updated int"


def events(spark, root, *batches):
    for rows in batches:
        spark.createDataFrame(rows, RUNS).coalesce(1).write.mode("append").parquet(f"{root}/in")
        ST.write_run_events(ST.run_count_events(ST.read_landed(
            spark, f"{root}/in", RUNS, "parquet", 1)), f"{root}/out", f"{root}/progress") \
            .awaitTermination()
    counts = {(r["source_name"], r["day"].day): (r["runs"], r["jobs_new"], r["jobs_updated"])
              for r in ST.read_run_events(spark, f"{root}/out", "count").collect()}
    late = sorted((str(r["source_name"]), r["run_timestamp"], r["jobs_new"])
                  for r in ST.read_run_events(spark, f"{root}/out", "late").collect())
    return counts, late


def at(day, hour=0):
    return datetime(2026, 4, day, hour)


def test_counts_close_once_and_late_runs_are_listed(spark, tmp_path):
    """The query is stopped and started again after every batch."""
    counts, late = events(
        spark, str(tmp_path),
        [("a", at(1, 3), 1, 2), ("a", at(1, 9), 3, None), ("b", at(2), 5, 5), (None, at(1), 7, 7)],
        [("a", at(1, 23), 10, 0), ("b", at(6), 1, 1)],       # inside the two days, still counted
        [("a", at(1, 1), 99, 0), ("b", at(5, 5), 2, 2)],     # the first day is closed by now
        [("c", at(12), 1, 1), ("b", at(2, 2), 98, 0)])
    assert counts == {("a", 1): (3, 14, 2), ("b", 2): (1, 5, 5), (None, 1): (1, 7, 7),
                      ("b", 5): (1, 2, 2), ("b", 6): (1, 1, 1)}
    assert late == [("a", at(1, 1), 99), ("b", at(2, 2), 98)]


def test_a_run_without_a_time_is_listed(spark, tmp_path):
    counts, late = events(spark, str(tmp_path), [("a", at(1), 1, 1), ("a", at(9), 1, 1)])
    assert counts == {("a", 1): (1, 1, 1)} and late == []
    spark.createDataFrame([("a", None, 4, 4)], RUNS).write.mode("append").parquet(f"{tmp_path}/in")
    assert events(spark, str(tmp_path))[1] == []
    assert events(spark, str(tmp_path), [("a", at(20), 1, 1)])[1] == [("a", None, 4)]
