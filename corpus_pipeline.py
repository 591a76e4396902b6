"""The corpus pipeline: toxic documents go, repeated lines go, one document of each group of near copies stays,
documents with benchmark items go, and the rest is tokenised.

Each stage works on all that its predecessor kept. All but the last return the columns of their input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions.staging import delete_stages, owned_stages, stage
from tillroll.llm import bpe, catalog, contamination, jaccard, lines, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _columns(docs: DataFrame) -> list:
    """The columns of ``docs`` whatever their names."""
    return [F.col(f"`{name}`") for name in docs.columns]


def _free(docs: DataFrame, name: str) -> str:
    """A name for a helper column that no column of ``docs`` has."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Positive-unlabelled toxicity: documents with a score of 0.5 or more go."""
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    name = _free(docs, "toxicity")
    return toxicity.score(docs, model, name=name).filter(F.col(name) < 0.5).select(*_columns(docs))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fuzzy line dedup: of each component of alike lines one stays.

    Documents stay, if need be with an empty text: which of them are copies is for the next stage to say, and a row a
    document lets every stage be judged on its own input. Where there is a column n_chars, it is counted anew.
    """
    changed = lines.remove(docs)
    if "n_chars" not in docs.columns:
        return changed
    return changed.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: the document with the smallest id of each group stays."""
    groups = stage(jaccard.join(docs), "pipeline-groups")
    copies = groups.filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(stage(copies, "pipeline-copies"), "doc_id", "left_anti").select(*_columns(docs))


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Latent semantic retrieval: documents that hold a benchmark item go."""
    return contamination.remove(docs, _table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: per document the token count and the digests of ids and of the decoded bytes."""
    return bpe.digest(docs, public_tokenizers.path(catalog.BPE_RANKS))


STAGES = [
    ("toxicity", toxic),
    ("line_dedup", repeated_lines),
    ("jaccard_join", near_copies),
    ("decontamination", benchmark_items),
    ("byte_bpe", tokens),
]

#: No stage but the last has a SQL form that ends; tests/llm holds each stage against a plain form instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again as the next one's input.

    What a stage writes on its way goes when its result is written, and that goes when the next one's is; the last
    result stays for its reader.
    """
    docs, before = _table(spark, sf_dir, "documents"), []
    for name, step in STAGES:
        with owned_stages(spark) as paths:
            docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
            own = [paths.pop()]
        delete_stages(spark, before)
        before = own
    return docs
