"""Times the four analyses on all four models, as stored tables, and prints one JSON line.

The models are built from $BENCH_SF_DIR first (reported as "load"); then each analysis runs once on
each model to warm up, and then $BENCH_RUNS times on the clock, results collected. "value" is the
sum of the means.
"""

import json
import os
import statistics
import tempfile
import time

from registry.queries import resolved_tables
from tradewind.operators.storage import table_scope
from tradewind.plans.analyses import ANALYSES, analyse
from tradewind.plans.load import MODELS, tables_of, write_models
from tradewind.session import local_session
from tradewind.sources.tables import read_tables
from tradewind.sources.testdata import KEYWORDS

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "5"))


def load(spark, folder: str) -> dict[str, dict]:
    resolved = resolved_tables(spark, SF_DIR)
    write_models(resolved, folder)
    return {form: read_tables(spark, f"{folder}/{form}", list(tables_of(resolved, form))) for form in MODELS}


def seconds(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def main() -> None:
    spark = local_session(CPUS, "tradewind-bench")
    loaded = {}
    load_time = seconds(lambda: loaded.update(load(spark, tempfile.mkdtemp(prefix="tradewind-bench-"))))

    def run_one(name: str, form: str):
        with table_scope(spark):
            return analyse(name, form, loaded[form], KEYWORDS).collect()

    runs = {f"{name}_{form}": lambda name=name, form=form: run_one(name, form) for name in ANALYSES for form in MODELS}
    for run in runs.values():
        run()
    timings = {name: round(statistics.mean(seconds(run) for _ in range(RUNS)), 3) for name, run in runs.items()}
    report = {
        "metric": "sum of mean seconds per analysis and model",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "load": round(load_time, 3),
        "runs": RUNS,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(report))
    spark.stop()


if __name__ == "__main__":
    main()
