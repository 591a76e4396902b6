"""Times the staging steps and the headline queries; prints one JSON line.

BENCH_SF_DIR names the input folder, BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tillroll.functions.staging import new_path  # noqa: E402
from tillroll.plans import catalog  # noqa: E402
from tillroll.plans.workspace import Workspace  # noqa: E402
from tillroll.session import build_session  # noqa: E402
from tillroll.sources import writers  # noqa: E402

STAGES = (
    "raw", "clean", "customers", "products", "orders", "order_items", "sales", "receipts", "rfm", "scores",
)
HEADLINE = (
    "profile_main_info", "missing_profile", "describe_sales", "quantile_table", "duplicate_stats",
    "drop_exact_duplicates", "distinct_counts", "cleaning_report", "top_n_rows", "fd_check", "dim_products",
    "fact_orders", "fact_order_items", "check_unique", "check_fk_items_orders", "check_domain", "v_sales",
    "v_invoice_summary", "core_metrics", "monthly_metrics", "mom_growth", "yoy_compare", "repeat_rate",
    "orders_histogram", "order_groups", "cohort_retention", "retention_matrix", "rfm_customer", "rfm_quantiles",
    "rfm_segments", "rfm_segment_summary", "country_summary", "product_summary", "product_concentration",
    "weekday_activity", "hour_activity", "known_unknown_revenue",
)


def run(df) -> None:
    """Compute every row and column without bringing them to the driver."""
    df.write.format("noop").mode("overwrite").save()


def sinks(ws: Workspace) -> dict:
    """The sinks, each writing to a new folder."""
    return {
        "publish_tables": lambda: writers.publish_tables(ws.entities, new_path(ws.spark, "published")).collect(),
        "publish_catalog": lambda: run(catalog.query_named("publish_catalog")(ws)),
        "layout_tables": lambda: writers.layout_tables(ws.clean, new_path(ws.spark, "layout")),
        "sink_csv_tables": lambda: writers.sink_csv_tables(ws.entities, new_path(ws.spark, "csv")),
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="12g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="tillroll-bench-"),
        # Test files are small: let one scan use all cores.
        spark__sql__files__openCostInBytes="262144",
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings = {}

    def timed(name, work, times=1) -> None:
        """The median of so many runs."""
        took = []
        for _ in range(times):
            start = time.perf_counter()
            work()
            took.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(took), 3)

    # The first workspace warms the JVM; the others are timed, and the median of each stage counts.
    stages = {name: [] for name in STAGES}
    for turn in range(4):
        if turn:
            ws.drop()
        ws = Workspace(spark, sf_dir)
        for name in STAGES:
            timed(f"stage_{name}", lambda name=name: getattr(ws, name))
            if turn:
                stages[name].append(timings[f"stage_{name}"])
    timings.update({f"stage_{name}": statistics.median(took) for name, took in stages.items()})
    for name in HEADLINE:
        fn = catalog.query_named(name)
        run(fn(ws))
        timed(name, lambda fn=fn: run(fn(ws)), 3)
    for name, work in sinks(ws).items():
        timed(name, work)
    ws.drop()
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "order_line_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
