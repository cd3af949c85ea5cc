"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Postings are first landed as a stored table, as they are in operation; that step is timed
on its own. Each query then runs twice and the second run counts; first runs, which include
planning and code generation from cold, are reported beside it.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from catalog import bindings as B
from catalog.browse_queries import _incoming, _stored, replies
from catalog.sqlgen import CFG, SCORED_CFG
from rolesift.functions import text as X
from rolesift.operators import browse as BR
from rolesift.operators import prefilter, reports, tables, verdicts, weighted
from rolesift.session import build_session, work_folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    root = f"{work_folder(spark)}/bench"

    def save(df, name):
        df.repartition(int(cpus)).write.mode("overwrite").parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    def run(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    start = time.time()
    companies = save(B.companies(spark, sf_dir), "companies")
    postings = save(B.postings(spark, sf_dir), "postings")
    replied = save(replies(spark, sf_dir), "replies")
    known = save(B.verdicts(spark, sf_dir), "verdicts")
    stored = save(_stored(spark, sf_dir), "stored")
    incoming = save(_incoming(spark, sf_dir), "incoming")
    scored_plan = verdicts.score_combined(postings, known, SCORED_CFG, B.as_of(), companies)
    scored = save(scored_plan, "scored")
    docs = save(B.table(spark, sf_dir, "documents").select("doc_id", "text"), "documents")
    prepared = time.time() - start
    phrases = [p for ps in CFG.positive_signals.values() for p in ps]
    spec = BR.BrowseSpec(min_qol=20, work_modes=["remote", "hybrid"], min_salary=50000)

    def rescored():
        old = postings.withColumns({"score": F.lit(0), "semantic_scored_at":
                                    F.lit(None).cast("timestamp")})
        return tables.rescore(old, known, SCORED_CFG, B.as_of(), companies)

    work = {
        "browse": lambda: BR.browse(scored, spec).collect(),
        "page_totals": lambda: BR.page_totals(BR.filter_status(scored), spec).collect(),
        "dedup": lambda: run(BR.dedup_postings(BR.project_browse(scored))),
        "stats": lambda: reports.active_stats(scored).collect(),
        "audit_summary": lambda: reports.audit_summary(reports.with_audit(scored)).collect(),
        "prefilter": lambda: run(prefilter.prefilter(postings, CFG, companies)),
        "weighted_score": lambda: run(weighted.weighted_score(postings, CFG, companies)),
        "score_combined": lambda: run(scored_plan),
        "rescore": lambda: run(rescored()),
        "upsert": lambda: run(tables.upsert_postings(stored, incoming)),
        "verdict_parse": lambda: run(verdicts.parse(replied)),
        "phrases_in_documents": lambda: run(docs.select("doc_id", X.find_phrases(
            F.lower("text"), phrases))),
    }
    cold, warm = {}, {}
    for name, job in work.items():
        for times in (cold, warm):
            start = time.time()
            job()
            times[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(warm.values()), 3), "unit": "sec",
        "queries": warm, "first_run": cold, "prepare": round(prepared, 3),
        "postings": postings.count(), "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
