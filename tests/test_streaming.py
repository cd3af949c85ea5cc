import json
from datetime import datetime

from pyspark.sql import functions as F

from rolesift.operators.tables import current_snapshot, read_snapshot
from rolesift.session import shared_folder
from rolesift.sources.specs import SPECS, normalize_source
from rolesift.streaming import ingest as S

NOW = datetime(2026, 4, 20)


def land(spark, root, *ids, title="VP"):
    rows = [("remoteok", NOW, json.dumps({"id": i, "title": title, "company": "A"})) for i in ids]
    spark.createDataFrame(rows, S.LANDED).write.mode("append").json(f"{root}/landed")


def drain(spark, root):
    def normalize(batch):
        return normalize_source(batch, SPECS["remoteok"], F.lit(NOW))
    S.stream_upsert(S.read_landed(spark, f"{root}/landed"), normalize, f"{root}/table",
                    f"{root}/progress").awaitTermination()
    return {r["job_id"]: r["title"] for r in read_snapshot(spark, f"{root}/table").collect()}


def test_draining_twice_changes_nothing(spark):
    root = f"{shared_folder(spark)}/stream"
    land(spark, root, 1, 2)
    first = drain(spark, root)
    assert first == {"remoteok:1": "VP", "remoteok:2": "VP"}
    version = current_snapshot(spark, f"{root}/table")
    assert drain(spark, root) == first
    assert current_snapshot(spark, f"{root}/table") == version


def test_late_redelivery_updates_in_place(spark):
    root = f"{shared_folder(spark)}/stream2"
    land(spark, root, 1)
    drain(spark, root)
    land(spark, root, 1, 3, title="CTO")
    assert drain(spark, root) == {"remoteok:1": "CTO", "remoteok:3": "CTO"}


def test_watermarked_dedup_and_daily_counts(spark):
    root = f"{shared_folder(spark)}/stream3"
    rows = [(f"j{i % 5}", datetime(2026, 4, 1 + i % 2), "s", 1, 2) for i in range(20)]
    spark.createDataFrame(rows, "job_id string, scraped_at timestamp, source_name string, "
                          "jobs_new int, jobs_updated int").write.json(f"{root}/in")
    schema = ("job_id string, scraped_at timestamp, source_name string, jobs_new int, "
              "jobs_updated int")
    stream = S.read_landed(spark, f"{root}/in", schema)
    q = S.dedup_deliveries(stream, "30 days").writeStream.format("memory").queryName("dd") \
        .option("checkpointLocation", f"{root}/p1").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["job_id"] for r in spark.table("dd").collect()) == [f"j{i}" for i in range(5)]
    runs = S.read_landed(spark, f"{root}/in", schema).withColumnRenamed("scraped_at",
                                                                       "run_timestamp")
    q = S.run_counts(runs).writeStream.format("memory").queryName("rc").outputMode("complete") \
        .option("checkpointLocation", f"{root}/p2").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["runs"], r["jobs_new"], r["jobs_updated"]) for r in spark.table("rc").collect())
    assert got == [(10, 10, 20), (10, 10, 20)]
