"""Wall-clock of the benchmark queries: one JSON line.

Each query runs once to warm up and then ``BENCH_RUNS`` times (3); its figure is the median,
of computing all rows without writing them. The tables are analyzed once before, so
that joins are ordered by statistics; ``without_statistics`` has the medians before that.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tidemark import queries  # noqa: E402
from tidemark.session import local_session  # noqa: E402
from tidemark.sources import TableCatalog  # noqa: E402


def timed(spark, folder: str, runs: int, catalog) -> dict[str, float]:
    out = {}
    for name in queries.BENCH:
        times = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            queries.run(spark, folder, name, catalog=catalog).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        out[name] = round(median(times[1:]), 4)
    return out


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores, runs = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "3"))
    with tempfile.TemporaryDirectory() as warehouse:
        spark = local_session(cores, **{"spark.driver.memory": "8g", "spark.sql.warehouse.dir": warehouse})
        spark.sparkContext.setLogLevel("ERROR")
        plain = timed(spark, folder, runs, None)
        began = time.perf_counter()
        catalog = TableCatalog.of_folder(spark, folder, queries.TABLES).analyze()
        analyzed = round(time.perf_counter() - began, 4)
        out = timed(spark, folder, runs, catalog)
        spark.stop()
    print(json.dumps({"metric": "total median seconds of b1 to b10", "value": round(sum(out.values()), 4), "unit": "sec", "queries": out, "sf": Path(folder).name.removeprefix("sf"), "cores": cores, "runs": runs, "without_statistics": plain, "analyze": analyzed}))


if __name__ == "__main__":
    main()
