"""Fuzzy line deduplication by MinHash, in DataFrame operations only.

1. Every line that is not blank (trimmed) has a set of character shingles: ``SHINGLE`` characters from each word start on,
   over following words, and from every place within a word from which the word has as many. One rule for lines of every
   script and length; every character is in a shingle, and a changed one touches only shingles around it. The signature
   are the minima of the shingles' hashes, each under another exclusive-or and hashed again. Lines are keyed by a
   64-bit hash of their characters and signatures are minima, so equal lines fall together before the shuffle.
2. ``BANDS`` bands of ``ROWS`` minima each propose candidates. Lines that are alike to ``SIMILARITY`` or more share a
   bucket with a chance of 98.6 percent or more. Every line of a bucket first meets its smallest and its largest line. Where
   that leaves a bucket in several components, all its lines of different components meet that their sizes and
   parity bitmaps allow to be alike: bits that differ are shingles that differ, of which alike sets have few.
3. Candidates are verified exactly: the Jaccard similarity of their shingle sets, each hashed once.
4. Components of the verified links are found by distributed union-find. Of each component, and of the occurrences of
   each repeated line, the first by doc_id and place stays; all others are removed from their documents.

Lines end at line feeds. Blank lines stay. A null text stays null. Rows that repeat both id and text are one document.
An empty table gives an empty one; among equal lines the smallest (doc_id, place) stays, so ties have one outcome.
Documents keep all their columns, whatever their names, also when no line is left (the text is then empty).
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.staging import stage
from tillroll.llm.components import components

SHINGLE, BANDS, ROWS = 8, 6, 3
SIMILARITY = 0.8
#: 64-bit words of a line's parity bitmap.
WORDS = 4
#: Lines of a bucket that one task holds against the others of the bucket; larger buckets are dealt to several.
TILE = 2000
#: A table of ids of this many rows may be broadcast.
BROADCAST_ROWS = 300_000

#: A shingle, then on to the next place: past the word if no more of it is left than a shingle holds, else by one character.
_PLACES = rf"(?s)(?=(.{{1,{SHINGLE}}}))(?:[^ ]{{1,{SHINGLE}}}+(?![^ ]) *+|[^ ])"


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, doc (a key of the row), place, line (the key of the characters) and its characters; no blank lines."""
    split = docs.select(
        "doc_id", F.xxhash64("doc_id", "text").alias("doc"), F.posexplode(F.split("text", "\n")).alias("place", "chars")
    )
    trimmed = split.withColumn("chars", F.btrim("chars", F.lit(" \r"))).filter("chars <> ''")
    return trimmed.withColumn("line", F.xxhash64("chars"))


def shingles(chars: Column) -> Column:
    """A line's character shingles, repeated ones too."""
    return F.regexp_extract_all(chars, F.lit(_PLACES), F.lit(1))


def _signatures(lines: DataFrame) -> DataFrame:
    """One row per different line: its minima and how often it occurs."""
    each = lines.select("line", F.posexplode(shingles(F.col("chars"))).alias("nth", "shingle"))
    hashed = each.select("line", "nth", F.hash("shingle").alias("h"))
    masks = random.Random(0)
    # hashed again, as an exclusive-or alone leaves few different orders of a short line's shingles
    mixed = [F.hash(F.col("h").bitwiseXOR(F.lit(masks.randrange(1 << 32) - (1 << 31)))) for _ in range(BANDS * ROWS)]
    minima = [F.min(m).alias(f"m{i}") for i, m in enumerate(mixed)]
    return hashed.groupBy("line").agg(F.count_if(F.col("nth") == 0).alias("times"), *minima)


def _buckets(signatures: DataFrame) -> DataFrame:
    """line, bucket, and the bucket's smallest and largest line, of the buckets with several lines."""
    band = [F.xxhash64(F.lit(b), *(f"m{b * ROWS + r}" for r in range(ROWS))) for b in range(BANDS)]
    bucket = signatures.select("line", F.explode(F.array(*band)).alias("bucket"))
    ends = bucket.groupBy("bucket").agg(F.min("line").alias("least"), F.max("line").alias("most"))
    return bucket.join(ends.filter("least < most"), "bucket")


def _sets(buckets: DataFrame, lines: DataFrame) -> DataFrame:
    """line, the hashes of its shingles, how many they are, and their parity bitmap, of all lines that share a bucket."""
    wanted = stage(buckets.select("line").distinct(), "line-wanted")
    small = F.broadcast if wanted.count() <= BROADCAST_ROWS else lambda df: df
    picked = lines.select("line", "chars").join(small(wanted), "line", "left_semi")
    held = picked.groupBy("line").agg(F.min("chars").alias("chars")).select(
        "line", F.array_distinct(F.transform(shingles(F.col("chars")), lambda g: F.xxhash64(g))).alias("set")
    )
    bit = f"if(shiftright(h, 6) & {WORDS - 1} = {{}}, shiftleft(1L, cast(h & 63 as int)), 0L)"
    words = [F.expr(f"aggregate(set, 0L, (word, h) -> word ^ {bit.format(w)})").alias(f"w{w}") for w in range(WORDS)]
    return held.select("line", "set", F.size("set").alias("n"), *words)


def _may_be_alike() -> Column:
    """What sizes and bitmaps of sets with ``SIMILARITY`` in common must fulfil, of the sides a and b."""
    fits = F.least("n_a", "n_b") >= SIMILARITY * F.greatest("n_a", "n_b") - 1e-6
    apart = sum(F.bit_count(F.col(f"w{w}_a").bitwiseXOR(F.col(f"w{w}_b"))) for w in range(WORDS))
    return fits & (apart <= (1 - SIMILARITY) / (1 + SIMILARITY) * (F.col("n_a") + F.col("n_b")) + 1e-6)


def _side(held: DataFrame, side: str, *more: str) -> DataFrame:
    """The columns of one side of a pair: its line as ``side``, the others with its name at their end."""
    names = ["n", *(f"w{w}" for w in range(WORDS)), *more]
    return held.select(F.col("line").alias(side), *(F.col(x).alias(f"{x}_{side}") for x in names))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are alike."""
    left, right = _side(sets, "a", "set"), _side(sets, "b", "set")
    met = pairs.join(left, "a").join(right, "b").filter(_may_be_alike())
    common = F.size(F.array_intersect("set_a", "set_b"))
    return met.filter(common >= SIMILARITY * (F.col("n_a") + F.col("n_b") - common)).select("a", "b")


def _across(buckets: DataFrame, root: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of lines that share a bucket, have different roots and may be alike, each pair once.

    The bound stands in the condition of the join, so only pairs that pass it are made, and only in the first of the
    buckets they share. A bucket of many lines is dealt to several tasks: its lines fall to tiles, and each tile meets
    the whole bucket.
    """
    of = buckets.join(root, "line", "left").select("bucket", "line", F.coalesce("root", "line").alias("root"))
    ends = of.groupBy("bucket").agg(
        F.min("root").alias("first"), F.max("root").alias("last"), F.ceil(F.count("*") / TILE).cast("int").alias("tiles")
    )
    open_ = of.join(ends.filter("first < last").select("bucket", "tiles"), "bucket")
    mine = open_.groupBy("line").agg(F.collect_set("bucket").alias("mine"))
    held = stage(open_.join(sets.drop("set").join(mine, "line"), "line"), "line-open")
    own = held.withColumn("tile", F.pmod(F.xxhash64("line", "bucket"), "tiles").cast("int"))
    every = held.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    left = _side(own, "a", "root", "bucket", "tile", "mine")
    right = _side(every, "b", "root", "bucket", "tile", "mine")
    same = (F.col("bucket_a") == F.col("bucket_b")) & (F.col("tile_a") == F.col("tile_b"))
    apart = (F.col("b") < F.col("a")) & (F.col("root_a") != F.col("root_b"))
    first = F.array_min(F.array_intersect("mine_a", "mine_b")) == F.col("bucket_a")
    return left.join(right, same & apart & _may_be_alike() & first).select("a", "b")


def _groups(signatures: DataFrame, lines: DataFrame) -> DataFrame:
    """line and root of all lines that are linked."""
    buckets = stage(_buckets(signatures), "line-buckets")
    sets = stage(_sets(buckets, lines), "line-sets")
    lead = lambda name: buckets.select(F.greatest("line", name).alias("a"), F.least("line", name).alias("b"))
    first = lead("least").union(lead("most")).filter("b < a").distinct()
    links = stage(_verified(first, sets), "line-links")
    root = components(links).withColumnRenamed("node", "line")
    more = stage(_verified(_across(buckets, root, sets), sets), "line-links")
    if more.isEmpty():
        return root
    # the first links as one link from each line to its root
    known = root.select(F.col("line").alias("a"), F.col("root").alias("b"))
    return components(known.union(more)).withColumnRenamed("node", "line")


def repeated(docs: DataFrame) -> DataFrame:
    """doc, and the places of the lines to remove from it."""
    lines = _lines(docs)
    signatures = stage(_signatures(lines), "line-signatures")
    root = _groups(signatures, lines)
    often = signatures.filter("times > 1").select("line").join(root, "line", "left_anti")
    groups = root.unionByName(often.withColumn("root", F.col("line")))
    found = stage(lines.select("doc_id", "doc", "place", "line").join(groups, "line").drop("line"), "line-places")
    one = F.struct("doc_id", "doc", "place")
    first = found.groupBy("root").agg(F.min(one).alias("first"))
    rest = found.join(first, "root").filter(~one.eqNullSafe(F.col("first")))
    return rest.groupBy("doc").agg(F.collect_set("place").alias("places"))


def remove(docs: DataFrame, report: bool = False) -> DataFrame:
    """The documents without the lines that repeat another; ``report`` adds n_lines and n_removed.

    A column with one of these two names is then an error.
    """
    clash = {"n_lines", "n_removed"} & set(docs.columns) if report else ()
    if clash:
        raise ValueError(f"the table has columns named {sorted(clash)} already")
    places = stage(repeated(docs), "line-removals")
    # the row as one column, so that no name of it can clash; the lines as one, so that the text is split once
    rows = docs.select(F.xxhash64("doc_id", "text").alias("doc"), F.struct(*[f"`{x}`" for x in docs.columns]).alias("row"))
    joined = rows.join(places, "doc", "left").withColumn("lines", F.split("row.text", "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("places"))
    kept = F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    text = F.when(F.col("places").isNull(), F.col("row.text")).otherwise(kept)
    columns = [(text if name == "text" else F.col(f"row.`{name}`")).alias(name) for name in docs.columns]
    if report:
        columns += [
            F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
            F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_removed"),
        ]
    return joined.select(*columns)
