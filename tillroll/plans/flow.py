"""The whole flow: sources, stages, checks, published tables, views and summaries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tillroll.functions.columns import SOURCE_HEADERS, SOURCE_SCHEMA
from tillroll.functions.staging import owned_stages, stage
from tillroll.operators import cleaning, customers, entities, sales, views
from tillroll.sources import readers, writers


def run_flow(
    spark: SparkSession,
    sources: Mapping[str, str | list[str]],
    folder: str,
    *,
    schema: T.StructType = SOURCE_SCHEMA,
    headers: Mapping[str, str] = SOURCE_HEADERS,
    fmt: str = "parquet",
    multi_line: bool = False,
    view_prefix: str = "",
) -> dict[str, DataFrame]:
    """Read, clean, normalise, check, publish and summarise; nothing may exist at the targets.

    Writes ``raw`` and ``clean`` lines, the four ``tables`` and the four ``summaries`` (CSV)
    below ``folder``, registers tables and views for SQL, and returns the written tables and
    reports by name. A broken constraint stops the flow before anything is published. What the
    flow stages on its way is deleted at its end.
    """
    base = folder.rstrip("/")
    lines = readers.scan_labelled_union(spark, sources, schema, fmt=fmt, multi_line=multi_line)
    raw = readers.scan_stage(spark, writers.sink_stage(readers.rename_columns(lines, headers), f"{base}/raw"))
    clean = readers.scan_stage(spark, writers.sink_stage(cleaning.clean_lines(raw), f"{base}/clean"))

    with owned_stages(spark):
        made = entities.normalise(clean, staged=True)
        writers.publish_tables(made, f"{base}/tables")
        tables = {
            name: spark.read.schema(frame.schema).parquet(f"{base}/tables/{name}") for name, frame in made.items()
        }
        views.register_tables(tables, prefix=view_prefix)
        views.register_views(tables, prefix=view_prefix)

        sold = stage(views.v_sales(tables["order_items"], tables["orders"], tables["products"]), "sales")
        receipts = views.invoice_receipts(sold).stored(lambda rows: stage(rows, "receipts"))
        scores = stage(customers.rfm_scores(customers.rfm_customer(receipts)), "scores")
        reports = {
            "monthly_sales": sales.monthly_metrics(receipts),
            "rfm_segments": customers.rfm_segment_summary(customers.rfm_segments(scores)),
            "country_summary": sales.country_summary(receipts),
            "product_summary": sales.product_summary(sold, tables["products"]),
        }
        paths = writers.sink_csv_summaries(*reports.values(), f"{base}/summaries")
        shapes = {name: frame.schema for name, frame in reports.items()}

    written = {name: readers.scan_typed_csv(spark, paths[name], shape) for name, shape in shapes.items()}
    return {
        "raw": raw, "clean": clean, **tables, "table_counts": writers.published_counts(tables),
        "sales": views.v_sales(tables["order_items"], tables["orders"], tables["products"]),
        "cleaning_report": cleaning.cleaning_report(raw, clean), **written,
    }
