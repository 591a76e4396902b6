"""The staged tables that the registered queries share."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions.columns import LOAD_ORDER
from tillroll.functions.ranking import PLACE
from tillroll.functions.staging import delete_stages, new_path, owned_stages, stage
from tillroll.operators import cleaning, customers, entities, views
from tillroll.plans.inputs import TABLES, raw_lines


class Workspace:
    """Raw lines, clean lines, entities, sales, receipts and customer scores of one input folder.

    Each table is made once, on first use, and written to the shared folder; everything
    after it reads the written table. That is the hand-over between the steps of the flow
    (raw -> clean -> entities -> views -> reports), and it keeps the joins and the duplicate
    removal from being repeated by every report.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._lock = threading.RLock()
        self._tables: dict = {}
        self._paths: list[str] = []

    def made(self, name: str, build):
        """What ``build`` returns, made on first use; its stages belong to this workspace."""
        with self._lock:
            if name not in self._tables:
                with owned_stages(self.spark, delete=False) as paths:
                    self._tables[name] = build()
                self._paths += paths
            return self._tables[name]

    def _staged(self, name: str, build) -> DataFrame:
        return self.made(name, lambda: stage(build(), name))

    def run(self, query: Callable[[Workspace], DataFrame]) -> DataFrame:
        """What a query returns; the stages it makes belong to this workspace."""
        with owned_stages(self.spark, delete=False) as paths:
            found = query(self)
        with self._lock:
            self._paths += paths
        return found

    def new_path(self, label: str) -> str:
        """A path below the shared folder that belongs to this workspace."""
        path = new_path(self.spark, label)
        with self._lock:
            self._paths.append(path)
        return path

    def drop(self) -> None:
        """Delete all that this workspace has written; its tables are made anew on their next use."""
        with self._lock:
            paths, self._paths, self._tables = self._paths, [], {}
            delete_stages(self.spark, paths)

    @property
    def raw(self) -> DataFrame:
        return self._staged("raw", lambda: raw_lines(self.spark, self.sf_dir))

    @property
    def placed(self) -> DataFrame:
        """Clean lines, written in the order that numbers them."""

        def made() -> DataFrame:
            in_order = lambda lines: entities.lines_in_places(lines, self.raw.count())
            return cleaning.clean_lines(self.raw, written=True, arranged=in_order)

        return self._staged("clean", made)

    @property
    def clean(self) -> DataFrame:
        return self.placed.drop(PLACE)

    @property
    def customers(self) -> DataFrame:
        return self._staged("customers", lambda: entities.dim_customers(self.clean))

    @property
    def products(self) -> DataFrame:
        return self._staged("products", lambda: entities.dim_products(self.clean))

    @property
    def orders(self) -> DataFrame:
        return self._staged("orders", lambda: entities.fact_orders(self.clean))

    @property
    def order_items(self) -> DataFrame:
        """Numbered by the places of the clean lines; neither sorted nor written a second time."""
        return self.made("order_items", lambda: entities.items_in_places(self.placed))

    @property
    def entities(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in LOAD_ORDER}

    @property
    def sales(self) -> DataFrame:
        """Lines of ``v_sales``."""
        return self._staged("sales", self._v_sales)

    def _v_sales(self) -> DataFrame:
        return views.v_sales(self.order_items, self.orders, self.products, orders_last=True)

    @property
    def receipts(self) -> views.Receipts:
        """Receipts of ``v_sales``: one row per invoice.

        Without sales at hand, only the columns that receipts are made of are joined and written.
        """

        def made() -> views.Receipts:
            if "sales" in self._tables:
                sold = self.sales
            else:
                sold = stage(self._v_sales().select(*views.receipt_columns()), "sold")
            return views.invoice_receipts(sold).stored(lambda rows: stage(rows, "receipts"))

        return self.made("receipts", made)

    @property
    def rfm(self) -> DataFrame:
        """Recency, frequency and money per customer of ``v_sales``."""
        return self._staged("rfm", lambda: customers.rfm_customer(self.receipts))

    @property
    def scores(self) -> DataFrame:
        return self._staged("scores", lambda: customers.rfm_scores(self.rfm))

    @property
    def line_sales(self) -> DataFrame:
        """Clean sales lines with their own time, customer and country."""
        return cleaning.filter_sales(self.clean)

    @property
    def line_receipts(self) -> views.Receipts:
        return views.receipts(self.line_sales)


_open: dict[tuple, tuple[tuple, Workspace]] = {}
_open_lock = threading.Lock()


def _fingerprint(spark: SparkSession, sf_dir: str) -> tuple:
    """Paths, sizes and times of change of the input files in one row, so that changed inputs are staged anew."""
    folders = [f"{sf_dir.rstrip('/')}/{name}.parquet" for name in TABLES]
    files = spark.read.format("binaryFile").load(folders).select("path", "length", "modificationTime")
    mark = F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))
    return tuple(files.agg(F.count("*"), F.sum("length"), F.max("modificationTime"), mark).first())


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    """The workspace of this application for an input folder in its present state.

    When the inputs have changed, the stages of their former state are deleted.
    """
    key, mark = (spark.sparkContext.applicationId, sf_dir.rstrip("/")), _fingerprint(spark, sf_dir)
    with _open_lock:
        before, found = _open.get(key, (None, None))
        if before != mark:
            if found:
                found.drop()
            found = Workspace(spark, sf_dir)
            _open[key] = (mark, found)
        return found
