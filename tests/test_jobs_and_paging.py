import csv
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselens.operators import paging, portfolio
from caselens.sources.exports import read_csv
from caselens.sources.jobs import Jobs
from caselens.sources.store import Store

CASES = [{"case_id": f"C{i}", "alert_id": f"A{i}", "analyst_id": "AN1", "queue_id": "Q1", "opened_at": f"2024-03-01T0{i}:00:00", "closed_at": "", "status": "OPEN"} for i in range(4)]
EVENTS = [{"case_id": f"C{i}", "event": "reassigned", "actor": "ab"[k % 2], "ts": f"2024-03-01T0{i}:{k:02}:00", "handover_reason": ""} for i in range(4) for k in range(3)]


def export(folder, events=EVENTS):
    for name, rows in (("cases", CASES), ("case_events", events)):
        with open(folder / f"{name}.csv", "w", newline="") as f:
            out = csv.DictWriter(f, rows[0])
            out.writeheader()
            out.writerows(rows)


def test_submissions_in_the_background(spark, tmp_path):
    jobs, store = Jobs(spark), Store(spark, str(tmp_path / "store"))
    (tmp_path / "in").mkdir()
    export(tmp_path / "in")
    ids = [jobs.ingest(lambda: read_csv(spark, str(tmp_path / "in")), e, store, "b1", "2024-03-05 00:00:00") for e in ("E", "F")]
    assert {jobs.status(i).state for i in ids} <= {"running", "done"}
    for i, e in zip(ids, ("E", "F"), strict=True):
        got = jobs.wait(i, 300)
        assert (got.state, got.cse_id, got.error) == ("done", e, None)
    assert sorted(r.cse_id for r in store.entities().collect()) == ["E", "F"] and store.read_log("F", "b1").event.count() > 8
    (tmp_path / "empty").mkdir()
    lost = jobs.wait(jobs.ingest(lambda: read_csv(spark, str(tmp_path / "empty")), "G", store, "b1", "2024-03-05 00:00:00"), 300)
    assert lost.state == "error" and lost.error
    jobs.forget(ids[0])
    assert jobs.status(ids[0]) == jobs.status("no such job") and jobs.status(ids[0]).error == "unknown job"
    assert jobs.status(ids[1]).state == "done"


def test_a_job_is_cancelled_by_its_tag(spark):
    jobs = Jobs(spark)
    slow = F.udf(lambda x: time.sleep(0.2) or x, "long")
    one = jobs.start("E", lambda: spark.range(0, 2000, 1, 2).select(slow("id")).collect())
    other = jobs.start("F", lambda: spark.range(10).count())
    assert jobs.wait(other, 60).state == "done"
    for _ in range(100):
        if jobs.status(one).tasks:
            break
        time.sleep(0.1)
    assert jobs.status(one).state == "running" and jobs.status(one).tasks >= 2
    began = time.time()
    jobs.cancel(one)
    assert jobs.wait(one, 60).state == "cancelled" and time.time() - began < 60


def concerns(spark, n=1200):
    rng = np.random.default_rng(2)
    rows = [(f"E{rng.integers(3)}", ["REASSIGNMENT_LOOP", "MISSING_ENRICHMENT", "FAST_CLOSE_OUTLIER"][rng.integers(3)], f"INC{i:07}", "Cap", "EXPECTED", "HIGH", None if i % 3 else f"a>b>{i}", float(rng.integers(5))) for i in range(n)]
    return spark.createDataFrame(rows, "cse_id string, finding_type string, primary_id string, capability string, authority string, evidence_quality string, detail string, concern_score double")


def test_pages_by_number_and_by_key(spark, tmp_path):
    rows = concerns(spark)
    pages = paging.Pages.write(rows, str(tmp_path / "p"), paging.by_score(), per_part=100)
    want = [tuple(r) for r in rows.orderBy(F.desc("concern_score"), "cse_id", "finding_type", "primary_id").collect()]
    got, cursor = [], None
    for number in range(3):
        page = pages.after(cursor, 70)
        assert [tuple(r) for r in page.collect()] == [tuple(r) for r in pages.page(number, 70).collect()] == want[70 * number : 70 * (number + 1)]
        got += page.collect()
        cursor = pages.cursor(page, paging.by_score())
    assert [tuple(r) for r in pages.page(17, 70).collect()] == want[1190:] and pages.page(18, 70).isEmpty()
    assert len([tuple(r) for r in pages.after(cursor, 300).collect()]) == 300
    one = pages.page(4, 25)
    assert re.search(r"PartitionFilters: \[[^\]]*_part", one._jdf.queryExecution().executedPlan().toString()) and pages.index.count() >= 8
    assert one.count() == 25
    assert paging.Pages.write(rows.limit(0), str(tmp_path / "none"), paging.by_score()).page(0).isEmpty()


@pytest.mark.parametrize("text", ["loop", "INC00001", "a>b>9", "lo", "", "no such text", "LOOP inc", "é"])
def test_search_by_index_equals_the_scan(spark, tmp_path, text):
    rows = concerns(spark)
    index = paging.SearchIndex.write(rows, str(tmp_path / "s"), portfolio.shown, ["finding_type", "primary_id"], per_block=100)
    order = lambda df: sorted(map(str, df.collect()))
    assert order(index.search(text)) == order(portfolio.search(rows, text))
    every = {r[0] for r in index.rows.select("_block").distinct().collect()}
    if text == "loop":
        assert 0 < len(index.blocks(text)) < len(every) / 2
    if text == "no such text":
        assert index.blocks(text) == []
