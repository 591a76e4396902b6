"""Versioned publication, appended loads, and publishing under rules that are counted on the way."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from tillroll.functions.columns import LOAD_ORDER
from tillroll.functions.staging import folder_names, new_path, stage
from tillroll.operators import checks, cleaning, entities
from tillroll.sources import increments, versions, writers


def rows(df):
    return sorted(map(repr, df.collect()))


def counts(tables):
    return {name: frame.count() for name, frame in tables.items()}


ALL = {"customers": 4, "products": 7, "orders": 11, "order_items": 15}


@pytest.fixture(scope="module")
def early(clean):
    """The entities of the first source alone."""
    return {name: df.cache() for name, df in entities.normalise(clean.filter("source_period = 'P1'")).items()}


def broken(tables):
    """Tables whose last one cannot be written."""
    fails = F.when(F.col("quantity") < 10**6, F.raise_error(F.lit("disk full"))).cast("int")
    return {**tables, "order_items": tables["order_items"].withColumn("quantity", fails)}


def test_a_load_broken_half_way_leaves_the_former_state(spark, early, tables):
    folder = new_path(spark, "versions")
    first = versions.publish_version(early, folder)
    before = {name: rows(df) for name, df in versions.published(spark, folder).items()}
    with pytest.raises(Exception, match="disk full"):
        versions.publish_version(broken(tables), folder)
    with pytest.raises(checks.ConstraintError, match="orders_without_known_customer"):
        versions.publish_version({**tables, "customers": tables["customers"].limit(1)}, folder)
    assert {name: rows(df) for name, df in versions.published(spark, folder).items()} == before
    assert versions.current(spark, folder)[1] == first
    assert folder_names(spark, f"{folder}/customers") == [f"load={first}"], "nothing of the failed loads is left"


def test_versions_stay_readable(spark, early, tables):
    folder = new_path(spark, "versions")
    with pytest.raises(LookupError):
        versions.published(spark, folder)
    first = versions.publish_version(early, folder)
    held = versions.published(spark, folder)
    second = versions.publish_version(tables, folder)
    assert counts(held) == counts(versions.published(spark, folder, first)) == counts(early)
    assert counts(versions.published(spark, folder)) == counts(versions.published(spark, folder, second)) == ALL
    with pytest.raises(LookupError, match="no-such"):
        versions.published(spark, folder, "no-such")
    third = versions.publish_version(early, folder)
    gone = versions.remove_loads(spark, folder, keep=2)
    assert len(gone) == 4 and all(first in path for path in gone)
    assert counts(versions.published(spark, folder, second)) == ALL
    assert versions.current(spark, folder)[:2] == (3, third)


def test_two_writers_of_one_number(spark, tables, early):
    """Both publish; every reader takes the same one, whole."""
    folder = new_path(spark, "versions")
    versions.publish_version(early, folder)
    seq, one = versions.new_version(spark, folder)
    for version, held in ((one, early), (f"{seq:06d}-zzz", tables)):
        writers.load_checked(held, {name: versions.load_path(folder, name, version) for name in LOAD_ORDER})
        versions.announce(spark, folder, seq, version, {name: [version] for name in LOAD_ORDER})
    assert counts(versions.published(spark, folder)) == ALL


def test_views_turn_together(spark, early, tables):
    folder, schema = new_path(spark, "versions"), "tillroll_versions"
    versions.publish_version(early, folder)
    names = versions.publish_views(spark, folder, schema)
    assert {n.split(".")[1] for n in names} >= {"customers", "v_sales", "v_monthly_metrics"}
    seen = lambda: {name: spark.table(f"{schema}.{name}").count() for name in LOAD_ORDER}
    assert seen() == counts(early)
    with pytest.raises(Exception, match="disk full"):
        versions.publish_version(broken(tables), folder)
    versions.refresh_views(spark, schema)
    assert seen() == counts(early)
    versions.publish_version(tables, folder)
    versions.refresh_views(spark, schema)
    assert seen() == ALL
    assert spark.table(f"{schema}.v_sales").count() == 11
    assert float(spark.sql(f"select sum(revenue) from {schema}.v_monthly_metrics").first()[0]) == 1110.5
    spark.sql(f"drop schema {schema} cascade")


def counted(spark, df):
    """``df`` and an accumulator of the rows that were computed of it."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema), seen


def test_order_items_are_read_once_before_publishing(spark, tables):
    frame, seen = counted(spark, tables["order_items"])
    writers.publish_tables({**tables, "order_items": frame}, new_path(spark, "published")).collect()
    assert seen.value == 15


def test_broken_rows_publish_nothing(spark, tables):
    folder = new_path(spark, "refused")
    bad = tables["orders"].withColumn("country", F.when(F.col("country") != "EIRE", F.col("country")))
    with pytest.raises(checks.ConstraintError, match="not null orders.country: 2"):
        writers.publish_tables({**tables, "orders": bad}, folder)
    assert folder_names(spark, folder) == []


def test_publishing_again(spark, early, tables):
    folder = new_path(spark, "published")
    writers.publish_tables(early, folder)
    with pytest.raises(FileExistsError, match="customers"):
        writers.publish_tables(tables, folder)
    with pytest.raises(ValueError, match="append"):
        writers.publish_tables(tables, folder, mode="append")
    again = writers.publish_tables(tables, folder, mode="overwrite")
    assert {r["table_name"]: r["rows_count"] for r in again.collect()} == ALL
    assert folder_names(spark, folder) == sorted(LOAD_ORDER)


def test_expectations_counted_while_writing(spark, clean):
    frame, seen = counted(spark, clean)
    watched, result = cleaning.watch_expectations(frame)
    watched.write.parquet(new_path(spark, "watched"))
    assert rows(result()) == rows(cleaning.assert_expectations(clean))
    assert seen.value == 15
    watched, result = cleaning.watch_expectations(clean, strict=True)
    watched.write.parquet(new_path(spark, "watched"))
    with pytest.raises(cleaning.ExpectationError, match="no_cancelled"):
        result()


# --- loads that join published tables --------------------------------------------------------


def test_two_loads_equal_one(spark, clean):
    """A later source after an earlier one: the same tables, keys included, as both in one load."""
    cut = datetime.datetime(2010, 3, 1)
    one, two = new_path(spark, "one"), new_path(spark, "two")
    increments.append_lines(spark, one, clean)
    for lines in (clean.filter(F.col("invoice_date") < cut), clean.filter(F.col("invoice_date") >= cut)):
        increments.append_lines(spark, two, lines)
    whole, grown = increments.entities_of(spark, one), increments.entities_of(spark, two)
    assert {name: rows(df) for name, df in whole.items()} == {name: rows(df) for name, df in grown.items()}
    assert rows(whole["orders"]) == rows(entities.fact_orders(clean))
    assert rows(whole["products"]) == rows(entities.dim_products(clean))
    assert tuple(increments.load_report(spark, two).first()) == (2, 2, 4, 7, 11, 15)


def test_old_keys_and_files_stay(spark, clean):
    folder = new_path(spark, "appended")
    increments.append_lines(spark, folder, clean.filter("source_period = 'P2'"))
    old = increments.entities_of(spark, folder)["order_items"]
    kept, files = rows(old), sorted(old.inputFiles())
    times = [os.path.getmtime(name.removeprefix("file://")) for name in files]
    increments.append_lines(spark, folder, clean.filter("source_period = 'P1'"))
    now = increments.entities_of(spark, folder)["order_items"]
    assert kept == rows(now.filter(F.col("order_item_id") <= len(kept)))
    assert set(files) < set(now.inputFiles())
    assert [os.path.getmtime(name.removeprefix("file://")) for name in files] == times
    assert [r[0] for r in now.select("order_item_id").orderBy("order_item_id").collect()] == list(range(1, 16))


def test_a_source_delivered_twice_changes_nothing(spark, clean):
    folder = new_path(spark, "appended")
    increments.append_lines(spark, folder, clean)
    before = {name: rows(df) for name, df in increments.entities_of(spark, folder).items()}
    increments.append_lines(spark, folder, clean)
    increments.append_lines(spark, folder, clean.limit(0))
    assert {name: rows(df) for name, df in increments.entities_of(spark, folder).items()} == before


def test_copies_under_another_label(spark, clean):
    folder = new_path(spark, "appended")
    for label in ("P1", "P2"):
        increments.append_lines(spark, folder, clean.filter(F.col("source_period") == label), ignore_source=True)
    items = increments.entities_of(spark, folder)["order_items"]
    assert items.count() == clean.drop("source_period").distinct().count() == 14


def test_a_broken_load_leaves_the_tables(spark, clean):
    folder = new_path(spark, "appended")
    increments.append_lines(spark, folder, clean.filter("source_period = 'P1'"))
    before = {name: rows(df) for name, df in versions.published(spark, folder).items()}
    bad = clean.filter("source_period = 'P2'").withColumn("price", F.lit(None).cast("decimal(18,4)"))
    with pytest.raises(checks.ConstraintError, match="not null order_items.price"):
        increments.append_lines(spark, folder, bad)
    assert {name: rows(df) for name, df in versions.published(spark, folder).items()} == before
    increments.append_lines(spark, folder, clean.filter("source_period = 'P2'"))
    assert counts(increments.entities_of(spark, folder)) == ALL


def test_fingerprints_tell_missing_from_empty(spark):
    held = spark.createDataFrame(
        [(None, ""), ("", None), ("a", "b"), ("ab", ""), ("", "ab"), (None, None), ("1:a", "")], "x string, y string"
    )
    assert held.select(increments.fingerprint(["x", "y"])).distinct().count() == 7


def test_stages_and_published_tables_are_packed(spark, tables, clean):
    """Stages, publications and appended loads are written with the smaller packing."""
    folder = new_path(spark, "packed")
    versions.publish_version(tables, folder)
    increments.append_lines(spark, f"{folder}/grown", clean)
    held = [path for frame in versions.published(spark, folder).values() for path in frame.inputFiles()]
    held += stage(tables["orders"], "packed").inputFiles() + versions.published(spark, f"{folder}/grown")["order_items"].inputFiles()
    assert len(held) >= 6 and all(".zstd." in path for path in held)


def test_lines_of_one_fingerprint(spark, monkeypatch):
    """Of several lines the smallest stays, by broadcast or not; lines without repeats are not written again."""
    rows = [(1, "b", b"x"), (1, "a", b"x"), (2, None, b"y"), (3, "c", b"z"), (0, "z", b"z")]
    made = lambda held: spark.createDataFrame(held, "n int, name string, _fp binary")
    alone = made(rows[1:4])
    assert increments._one_of_each(alone) is alone
    for most in (10, 0):
        monkeypatch.setattr(increments, "REPEATED", most)
        found = [(r.n, r.name, bytes(r._fp)) for r in increments._one_of_each(made(rows)).collect()]
        assert sorted(found) == [(0, "z", b"z"), (1, "a", b"x"), (2, None, b"y")]
