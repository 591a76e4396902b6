"""Sources: labelled unions of same-shaped inputs, typed CSV and staged tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.functions.columns import SOURCE_HEADERS
from tillroll.functions.staging import stage

# CSV dialect of all files: comma, header, UTF-8, quotes doubled, empty field = missing.
CSV_OPTIONS = {
    "header": "true",
    "encoding": "UTF-8",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss[.SSSSSS]",
    "dateFormat": "yyyy-MM-dd",
}

# Reading tells a quoted empty text from a missing one by giving the latter a mark of its own.
CSV_READ_OPTIONS = {**CSV_OPTIONS, "nullValue": "\x01", "emptyValue": ""}


def scan_typed_csv(
    spark: SparkSession, path: str | list[str], schema: T.StructType, *, multi_line: bool = False
) -> DataFrame:
    """Read CSV against a declared schema; a wrong header or a malformed value fails.

    ``multi_line`` allows line breaks inside quoted text, at the price of one task per file.
    """
    return (
        spark.read.options(**CSV_READ_OPTIONS)
        .option("mode", "FAILFAST")
        .option("enforceSchema", "false")
        .option("multiLine", str(multi_line).lower())
        .schema(schema)
        .csv(path)
    )


def scan_labelled_union(
    spark: SparkSession,
    sources: Mapping[str, str | list[str]],
    schema: T.StructType,
    *,
    label: str = "source_period",
    fmt: str = "parquet",
    multi_line: bool = False,
) -> DataFrame:
    """Append several same-shaped sources, each row tagged with the label of its source.

    ``multi_line`` reads CSV whose quoted texts hold line breaks (see ``scan_typed_csv``).
    """
    if not sources:
        raise ValueError("no sources given")

    def scan(path: str | list[str]) -> DataFrame:
        if fmt == "csv":
            return scan_typed_csv(spark, path, schema, multi_line=multi_line)
        paths = [path] if isinstance(path, str) else path
        return spark.read.format(fmt).schema(schema).load(paths)

    tagged = [scan(path).withColumn(label, F.lit(name)) for name, path in sources.items()]
    return reduce(DataFrame.unionByName, tagged)


_WHOLE = "^[+-]?[0-9]+$"
_NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def _typed(field: T.StructField) -> Column:
    """The text of a field as its type; NULL where it is none."""
    text = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.StringType):
        return text
    whole = isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    number = whole or isinstance(field.dataType, (T.DecimalType, T.FloatType, T.DoubleType))
    value = text.try_cast(field.dataType)
    return F.when(text.rlike(_WHOLE if whole else _NUMBER), value) if number else value


def scan_csv_with_rejects(
    spark: SparkSession, path: str | list[str], schema: T.StructType, *, multi_line: bool = False
) -> DataFrame:
    """Every line of CSV files: the columns of ``schema``, then ``_file``, ``_block``, ``_line`` and ``_reason``.

    A readable line has no reason. One with too many or too few fields has the reason ``fields``; one with values that are
    not of their type, or missing where the schema wants one, names them, ``quantity: many is not int``. Such lines have no columns but their text in ``_line``,
    and the file and the beginning of the block of it in which they stand. A wrong header still fails.
    """
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    marked = T.StructType([*texts, T.StructField("_line", T.StringType())])
    lines = (
        spark.read.options(**CSV_READ_OPTIONS)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_line")
        .option("columnPruning", "false")
        .option("enforceSchema", "false")
        .option("multiLine", str(multi_line).lower())
        .schema(marked)
        .csv(path)
        .select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    )
    wrong = [
        F.when(
            F.col(f"`{f.name}`").isNotNull() & _typed(f).isNull(),
            F.concat(F.lit(f"{f.name}: "), F.col(f"`{f.name}`"), F.lit(f" is not {f.dataType.simpleString()}")),
        )
        for f in schema
    ]
    empty = [F.when(F.col(f"`{f.name}`").isNull(), F.lit(f"{f.name}: missing")) for f in schema if not f.nullable]
    found = F.nullif(F.concat_ws("; ", *wrong, *empty), F.lit(""))
    reason = F.when(F.col("_line").isNotNull(), F.lit("fields")).otherwise(found)
    whole = F.coalesce("_line", F.to_csv(F.struct(*[F.col(f"`{f.name}`") for f in schema])))
    told = lines.select("*", reason.alias("_reason"))
    good = F.col("_reason").isNull()
    return told.select(
        *[F.when(good, _typed(f)).alias(f.name) for f in schema], "_file", "_block",
        F.when(~good, whole).alias("_line"), "_reason",
    )


def scan_union_with_rejects(
    spark: SparkSession,
    sources: Mapping[str, str | list[str]],
    schema: T.StructType,
    *,
    label: str = "source_period",
    multi_line: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Lines and rejects of several same-shaped CSV sources, each row tagged with the label of its source.

    The files are read and parsed once, into a stage that both tables are taken from, so the two always add up to the
    lines of the files. Lines are as ``scan_labelled_union`` has them; rejects are (label, file, block, line, reason).
    """
    if not sources:
        raise ValueError("no sources given")
    read = [
        scan_csv_with_rejects(spark, path, schema, multi_line=multi_line).withColumn(label, F.lit(name))
        for name, path in sources.items()
    ]
    every = stage(reduce(DataFrame.unionByName, read), "lines")
    lines = every.filter(F.col("_reason").isNull()).select(*[f"`{f.name}`" for f in schema], label)
    lost = every.filter(F.col("_reason").isNotNull())
    return lines, lost.select(
        label, F.col("_file").alias("file"), F.col("_block").alias("block"), F.col("_line").alias("line"),
        F.col("_reason").alias("reason"),
    )


def reject_report(lines: DataFrame, rejects: DataFrame, *, label: str = "source_period") -> DataFrame:
    """(label, lines_read, lines_rejected) of each source."""
    counted = [
        df.groupBy(label).agg(F.count("*").alias("n")).select(label, *[(F.col("n") if here else F.lit(0)).alias(x)
            for x, here in (("read", df is lines), ("lost", df is rejects))])
        for df in (lines, rejects)
    ]
    both = counted[0].unionByName(counted[1]).groupBy(label)
    return both.agg(F.sum("read").cast("long").alias("lines_read"), F.sum("lost").cast("long").alias("lines_rejected"))


def rename_columns(df: DataFrame, mapping: Mapping[str, str] = SOURCE_HEADERS) -> DataFrame:
    """Give source headers their model names; headers that are not mapped stay."""
    return df.withColumnsRenamed(dict(mapping))


def scan_stage(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Reload a stage written by ``sink_stage``."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)
