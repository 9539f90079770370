"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from tallymatch import queries as core  # noqa: E402

HEADLINES = ["all_flat", "all_nested", "repeated_id_mixing", "production_shape", "between_covering", "exclude_repeated_id", "compare_by", "first_match_per_probe", "match_counts", "ranked_results"]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run(core.queries()["include"](spark, sf_dir))  # the session's first query pays for starting up

    seconds, matches = {}, {}
    for name in HEADLINES:
        began = time.perf_counter()
        run(core.queries()[name](spark, sf_dir))
        seconds[name] = round(time.perf_counter() - began, 3)

    # the large shapes in their two parts: building an index, and pairs decided a second with it
    shapes = {}
    for name in ("all_flat", "production_shape"):
        case = core.CASES[name]
        began = time.perf_counter()
        index = case.index(spark, sf_dir)
        built = time.perf_counter() - began
        probes = core.views(spark, sf_dir, case.probes)
        began = time.perf_counter()
        matches = index.match(probes).count()
        took = time.perf_counter() - began
        n = probes.count()
        shapes[name] = {"rules": index.ids.count(), "probes": n, "build_sec": round(built, 3), "match_sec": round(took, 3), "matches": matches, "pairs_per_sec": round(n * index.ids.count() / took), "probes_per_sec": round(n / took)}

    # single probes against a built index, for comparison with per-call figures
    one = {"since": 100, "until": 101, "orders": 1, "customer": 100, "platform": 100 % 34, "slot_type": 1, "dbs": True, "market": 1, "region": 1, "major": 1, "minor": 0}
    local = index.local()
    began = time.perf_counter()
    index.search(**one)
    first = time.perf_counter() - began
    local.search(**one)
    began = time.perf_counter()
    for _ in range(1000):
        local.search(**one)
    shapes["single_probe"] = {"index_search_sec": round(first, 4), "local_search_sec": round((time.perf_counter() - began) / 1000, 9)}

    if "--llm" in sys.argv:
        from tallymatch.llm import queries as llm

        for name, query in llm.queries().items():
            began = time.perf_counter()
            run(query(spark, sf_dir))
            seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "shapes": shapes, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
