"""Time headline queries and print one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) choose data
and cores.  ``queries`` are annotated runs to a no-op sink (every row and column is
computed); ``plain`` are the same queries without provenance, ``overhead`` their ratio.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from whence.plans import registry, ssb, ssbplus, tpch
from whence.plans.base import Tables

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

# rows of the result, its gates, and the coarser forms
NAMES = [
    "flagship",
    *[f"tpch_q{i}" for i in range(1, 23)],
    "tpch_q1_circuit", "tpch_q3_circuit", "tpch_q5_circuit", "tpch_q9_circuit", "tpch_q18_circuit", "tpch_q21_circuit",
    "ssb_q1_1", "ssb_q2_1", "ssb_q3_1", "ssb_q4_1", "ssb_q2_1_circuit",
    "ssbplus_q5", "ssbplus_q6_2", "ssbplus_q7", "ssbplus_q10_1",
    "form_how", "form_trio", "form_why", "form_posbool", "form_lineage", "cells_how",
    "tensor_qty", "evaluate_tensor", "delete_tokens", "what_if_condition", "valuation",
    "validate_results", "validate_witnesses", "exists_expanded", "points_distance_join_avg",
]

# the same work without provenance
PLAIN = {
    **{f"tpch_q{i}": getattr(tpch, f"q{i}") for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 13, 15, 17, 18, 20, 21, 22)},
    "ssb_q1_1": lambda t: ssb.star(t, "d", "d_year = 1996 and l_discount between 0.01 and 0.03 and l_quantity < 25"),
    "ssbplus_q5": ssbplus.q5,
    "ssbplus_q7": ssbplus.q7,
}


def timed(make) -> float:
    start = time.perf_counter()
    df: DataFrame = make()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("whence-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    tables = Tables(spark, SF_DIR)
    queries = registry()
    timed(lambda: queries["tpch_q5"].run(spark, SF_DIR))  # start the JVM's compilers
    times = {name: round(timed(lambda n=name: queries[n].run(spark, SF_DIR)), 3) for name in NAMES}
    plain = {name: round(timed(lambda m=make: m(tables).plain()), 3) for name, make in PLAIN.items()}
    overhead = {name: round(times[name] / plain[name], 2) for name in plain}
    # rows alone hold gate names; with the circuit the derivations are computed too
    whole = {q: round((times[q] + times[f"{q}_circuit"]) / plain[q], 2) for q in plain if f"{q}_circuit" in times}
    print(
        json.dumps(
            {
                "metric": "provenance_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "plain": plain,
                "overhead": overhead,
                "overhead_with_circuit": whole,
                "sf": SF_DIR.rstrip("/").rsplit("/", 1)[-1].removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
