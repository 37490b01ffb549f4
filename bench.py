"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join([HERE, os.environ.get("PYTHONPATH", "")])

HEADLINE = ("reassignment_loops", "rule_response", "rule_precedence", "asset_recurrence", "negspace_analyst", "concerns", "submodular_selection", "entity_risk", "trend_classification", "ols_effect")


def main() -> None:
    from caselens.plans import catalogue
    from caselens.session import session

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="12g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__checkpoint__dir=tempfile.mkdtemp())
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        spark.catalog.clearCache()
        start = time.time()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "supervisory queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
