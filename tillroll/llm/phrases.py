"""Phrase collocations by Rabin-Karp fingerprints.

Texts fall into pieces and words. Prefix polynomials over the word hashes of a slice give the fingerprint of every
n-gram with one subtraction and one product. A task adds up equal fingerprints before the shuffle adds up those of all
tasks, so a phrase of any frequency is one entry a task there. Entries travel packed, those of one range of fingerprints
(a bucket) in one row.

The n-grams are counted by length: one of k words is only counted if both of its (k-1)-grams are frequent. Which are, the
tasks read from a bitmap of fixed size (``FILTER_BITS``); a bit set by another fingerprint only lets a rare n-gram be
counted in vain. A last pass counts the n-grams of all lengths that are left, now with a pointer to an occurrence (row,
place, length) and the least and greatest value of a second, independent fingerprint. Where the two differ, phrases share
a fingerprint and are counted anew by their text. All others are read from the text at their pointer, once each, and
their fingerprints compared. Only frequent phrases are ever made into text.

Everything is counted per language; a null one is ``und``, a null text is empty. A table without words has no phrases.
Repeated rows count as often as they stand there, other columns are not looked at, ties of the ranking go by the
phrase, and a text of any length is taken whole. The texts are staged once, so that a pointer means the same row in every
pass.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.functions.staging import stage
from tillroll.llm.text import (
    BYTE_VALUES, FOLDED_VALUES, ODD, mixed, powers, rolling, slices, span_hash, tidy, utf8, words,
)

#: Bits of the bitmap of frequent fingerprints that every task gets, 8 MB whatever the input.
FILTER_BITS = 1 << 26
#: Fingerprints a task gathers before it hands them on; bounds memory, not results.
HELD = 1 << 21
#: Pointers that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000

#: Bits at a fingerprint's end that do not count in the passes by length.
_CUT = 24

_U = np.uint64
_BASE = 0xD6E8FEB86659FD93
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

#: Where pieces end, and where words end: the same, blanks and tabs.
PIECE_END = np.zeros(256, bool)
PIECE_END[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
WORD_END = PIECE_END.copy()
WORD_END[[0x20, 0x09]] = True

_CHECK_VALUES = mixed(BYTE_VALUES + _U(ODD)) | _U(1)
_CHECK_VALUES[65:91] = _CHECK_VALUES[97:123]


class Grams:
    """The n-grams of a slice: their fingerprints, and where in the texts they stand."""

    def __init__(self, texts: pa.Array, langs: pa.Array, bits: int = 64, check: bool = False):
        self.data, self.bounds = utf8(texts)
        self.starts, self.ends, self.row = words(self.data, self.bounds, WORD_END)
        piece = np.cumsum(PIECE_END[self.data])[self.starts] if len(self.data) else self.starts
        apart = (piece[1:] != piece[:-1]) | (self.row[1:] != self.row[:-1])
        self.part = np.concatenate([[0], np.cumsum(apart)])[: len(self.starts)]
        named, at = utf8(langs)
        self.lang = span_hash(rolling(named), at[:-1], at[1:]) + at[1:].astype(_U) - at[:-1].astype(_U)
        self.mask = _U(((1 << bits) - 1) << (64 - bits))
        self.sums = self._prefix(FOLDED_VALUES)
        self.check_sums = self._prefix(_CHECK_VALUES) if check else None

    def _prefix(self, table: np.ndarray) -> np.ndarray:
        """Prefix polynomials of the words' hashes; a word's length counts too."""
        word = mixed(span_hash(rolling(self.data, table), self.starts, self.ends) + (self.ends - self.starts).astype(_U))
        sums = np.zeros(len(word) + 1, _U)
        np.cumsum(word * powers(_BASE, len(word)), out=sums[1:])
        return sums

    def at(self, k: int) -> np.ndarray:
        """Numbers of the words that begin an n-gram of ``k`` words."""
        m = max(0, len(self.starts) - k + 1)
        return np.flatnonzero(self.part[:m] == self.part[k - 1 :][:m])

    def _value(self, sums: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
        plain = (sums[at + k] - sums[at]) * powers(_BASE_INVERSE, len(sums))[at]
        return mixed(plain + self.lang[self.row[at]] * _U(2 * k + 1))

    def keys(self, at: np.ndarray, k: int) -> np.ndarray:
        return self._value(self.sums, at, k) & self.mask

    def checks(self, at: np.ndarray, k: int) -> np.ndarray:
        """32 bits of the second fingerprint, as whole numbers."""
        return (self._value(self.check_sums, at, k) >> _U(32)).astype(np.int64)

    def open(self, k: int, frequent: dict[int, np.ndarray]) -> np.ndarray:
        """Where an n-gram of ``k`` words may be frequent by the bitmap of the (k-1)-grams."""
        at = self.at(k)
        if k > 1 and len(at):
            at = at[listed(frequent[k - 1], self.keys(at, k - 1)) & listed(frequent[k - 1], self.keys(at + 1, k - 1))]
        return at

    def text(self, at: int, k: int) -> str:
        """The phrase in lower case, its words one blank apart."""
        held = bytes(self.data[self.starts[at] : self.ends[at + k - 1]])
        return b" ".join(x for x in held.lower().replace(b"\t", b" ").split(b" ") if x).decode()


def listed(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bit of each fingerprint is set."""
    place = (keys >> _U(_CUT)) & _U(FILTER_BITS - 1)
    return (bitmap[(place >> _U(3)).astype(np.int64)] >> (place & _U(7)).astype(np.uint8)) & 1 > 0


def _slim(bitmap: np.ndarray) -> np.ndarray:
    """The places of the bits that are set, or the bitmap itself where that is smaller."""
    places = np.flatnonzero(np.unpackbits(bitmap, bitorder="little")).astype(np.uint32)
    return places if places.nbytes < bitmap.nbytes else bitmap


def _opened(slim: np.ndarray) -> np.ndarray:
    """The bitmap of what ``_slim`` made of it."""
    if slim.dtype == np.uint8:
        return slim
    held = np.zeros(FILTER_BITS // 8, np.uint8)
    np.bitwise_or.at(held, slim >> 3, np.uint8(1) << (slim & 7).astype(np.uint8))
    return held


class Tally:
    """Counts by fingerprint, with further columns that are added up, kept least, greatest or first."""

    def __init__(self, how: dict[str, str], most: int | None = None):
        self.how, self.rows, self.parts, self.most = how, 0, [], most or HELD

    def add(self, key: np.ndarray, **columns: np.ndarray) -> None:
        if len(key):
            self.parts.append(self._folded(key, columns))
            self.rows += len(self.parts[-1][0])

    def _folded(self, key, columns):
        order = np.argsort(key, kind="stable")
        key = key[order]
        begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        fold = {"sum": np.add.reduceat, "min": np.minimum.reduceat, "max": np.maximum.reduceat}
        out = {}
        for name, way in self.how.items():
            held = columns[name][order]
            out[name] = held[begins] if way == "first" else fold[way](held, begins)
        return key[begins], out

    def full(self) -> bool:
        """Whether the task should hand on what it has; folds it first."""
        if self.rows < self.most:
            return False
        self._fold()
        return self.rows > self.most // 2

    def _fold(self) -> None:
        if len(self.parts) > 1:
            key = np.concatenate([part[0] for part in self.parts])
            columns = {name: np.concatenate([part[1][name] for part in self.parts]) for name in self.how}
            self.parts = [self._folded(key, columns)]
            self.rows = len(self.parts[0][0])

    def taken(self) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """All that was counted, by ascending fingerprint; begins anew after."""
        self._fold()
        key, columns = self.parts[0] if self.parts else (np.empty(0, _U), {x: np.empty(0, np.int64) for x in self.how})
        self.parts, self.rows = [], 0
        return key, columns


def _buckets(spark: SparkSession) -> int:
    """Bits of a fingerprint that tell its bucket: some buckets for each shuffle partition."""
    return min(16, max(8, int(spark.conf.get("spark.sql.shuffle.partitions")).bit_length() + 2))


def _split(key: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """The buckets of ascending fingerprints, and where each stands."""
    bucket = (key >> _U(64 - bits)).astype(np.int64)
    ends = [*(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(key)]
    for a, b in zip([0, *ends[:-1]], ends, strict=True):
        if a < b:
            yield int(bucket[a]), slice(a, b)


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers byte by byte of their width, so that bytes of alike numbers lie together and compress."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.dtype.itemsize).T).tobytes()


def _unplaned(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _pass(texts: DataFrame, work, schema: str) -> DataFrame:
    """``work`` over slices of the staged texts (row, lang, text); it yields columns by name."""
    return texts.mapInArrow(_arrow(lambda batches: work(slices(batches, 2)), schema), schema)


def _arrow(work, schema: str):
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    arrow = pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in schema.split(","))])

    def run(batches):
        for held in work(batches):
            yield pa.RecordBatch.from_arrays([pa.array(held[f.name], f.type) for f in arrow], schema=arrow)

    return tidy(run)


def count(texts: DataFrame, k: int, frequent, bits: int, least: int) -> DataFrame:
    """(place): where the bitmap has a bit for the n-grams of ``k`` words that are frequent, and for few others.

    Counted by the first 40 bits of a fingerprint, a bucket of them in one packed row of each task. A count beyond
    ``least`` says no more than ``least``.
    """
    split = _buckets(texts.sparkSession)
    kind = np.min_scalar_type(least)

    def packed(tally):
        key, columns = tally.taken()
        for bucket, at in _split(key, split):
            rest = (key[at] << _U(split)) >> _U(split + _CUT)
            steps = np.diff(rest, prepend=_U(0)).astype(np.uint32)
            few = np.minimum(columns["n"][at], least).astype(kind)
            yield {"bucket": [bucket], "key": [_planes(steps)], "n": [_planes(few)]}

    def work(batches):
        tally, before = Tally({"n": "sum"}), {x: _opened(held) for x, held in frequent.value.items()}
        for batch in batches:
            grams = Grams(batch.column(2), batch.column(1), bits)
            at = grams.open(k, before)
            key = (grams.keys(at, k) >> _U(_CUT)) << _U(_CUT)
            tally.add(key, n=np.ones(len(at), np.int64))
            if tally.full():
                yield from packed(tally)
        yield from packed(tally)

    def fold(batches):
        for bucket, rows in _by_bucket(batches, 0):
            tally = Tally({"n": "sum"})
            for row in rows:
                steps = _unplaned(row["key"], np.uint32).astype(_U)
                tally.add(np.cumsum(steps, dtype=_U), n=_unplaned(row["n"], kind).astype(np.int64))
            key, columns = tally.taken()
            key = key[columns["n"] >= least] | _U(bucket << (64 - split - _CUT))
            yield {"place": np.unique(key & _U(FILTER_BITS - 1)).astype(np.int64)}

    rows = _pass(texts, work, "bucket int, key binary, n binary")
    dealt = rows.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_arrow(fold, "place long"), "place long")


def _by_bucket(batches, *columns: int):
    """Rows with the same values in these columns, which they are sorted by, as dicts, one group at a time."""

    def rows():
        for batch in batches:
            for i in range(batch.num_rows):
                yield tuple(batch.column(c)[i].as_py() for c in columns), batch.slice(i, 1)

    for key, held in itertools.groupby(rows(), key=lambda x: x[0]):
        yield key[0] if len(key) == 1 else key, (one.to_pylist()[0] for _, one in held)


def bitmap(places: DataFrame) -> np.ndarray:
    """The bitmap of a column ``place``: made in Spark in blocks of 4 KB, at most ``FILTER_BITS`` bits in all."""
    blocks = places.groupBy(F.shiftright("place", 15).alias("block")).agg(
        F.bitmap_construct_agg(F.col("place").bitwiseAND((1 << 15) - 1)).alias("bits")
    )
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for block, held in blocks.collect():
        out[block * 4096 : (block + 1) * 4096] = np.frombuffer(bytes(held), np.uint8)
    return out


#: What stands in a packed row for each n-gram.
_PARTS = {"fp": _U, "n": np.uint32, "check": np.uint32, "row": np.int64, "start": np.uint32, "size": np.uint32}


def pointed(texts: DataFrame, longest: int, frequent, bits: int, least: int) -> DataFrame:
    """(k, fp, n, lo, hi, row, start, size) of frequent n-grams: counts with a pointer and the range of the second
    fingerprint, of which 32 bits travel.

    ``k`` 0 stands for the words of a language, ``fp`` being that of its name.
    """
    split = _buckets(texts.sparkSession)
    how = {"n": "sum", "lo": "min", "hi": "max", "row": "first", "start": "first", "size": "first"}
    packed_schema = "k int, bucket int, fp binary, n binary, lo binary, hi binary, row binary, start binary, size binary"
    kinds = _PARTS | {"lo": np.uint32, "hi": np.uint32}

    def packed(k, tally):
        key, columns = tally.taken()
        for bucket, at in _split(key, split):
            held = {name: [_planes(columns[name][at].astype(kinds[name]))] for name in how}
            if np.array_equal(columns["lo"][at], columns["hi"][at]):
                held["hi"] = [b""]  # no two phrases here: one value serves for both
            yield {"k": [k], "bucket": [bucket], "fp": [_planes(key[at])]} | held

    def work(batches):
        tally = {k: Tally(how, HELD // (longest + 1)) for k in range(longest + 1)}
        held_bits = {k: _opened(held) for k, held in frequent.value.items()}
        for batch in batches:
            grams = Grams(batch.column(2), batch.column(1), bits, check=True)
            row = batch.column(0).to_numpy()
            per_text = np.bincount(grams.row, minlength=batch.num_rows)
            some = np.flatnonzero(per_text)
            zero = np.zeros(len(some), np.int64)
            tally[0].add(grams.lang[some], n=per_text[some], lo=zero, hi=zero, row=row[some], start=zero, size=zero)
            for k in range(1, longest + 1):
                if k not in held_bits:
                    break
                at = grams.open(k, held_bits)
                key = grams.keys(at, k)
                keep = listed(held_bits[k], key)
                at, key = at[keep], key[keep]
                check, of = grams.checks(at, k), grams.row[at]
                start, size = grams.starts[at] - grams.bounds[of], grams.ends[at + k - 1] - grams.starts[at]
                tally[k].add(key, n=np.ones(len(at), np.int64), lo=check, hi=check, row=row[of], start=start, size=size)
            for k, held in tally.items():
                if held.full():
                    yield from packed(k, held)
        for k, held in tally.items():
            yield from packed(k, held)

    def fold(batches):
        for (k, _), rows in _by_bucket(batches, 0, 1):
            tally = Tally(how)
            for row in rows:
                row["hi"] = row["hi"] or row["lo"]
                wide = {name: _unplaned(row[name], kinds[name]).astype(np.int64) for name in how}
                tally.add(_unplaned(row["fp"], _U), **wide)
            key, columns = tally.taken()
            kept = (columns["n"] >= least) | (k == 0)
            out = {name: held[kept] for name, held in columns.items()}
            yield {"k": np.full(kept.sum(), k), "fp": key[kept].view(np.int64)} | out

    schema = "k int, fp long, n long, lo long, hi long, row long, start long, size long"
    rows = _pass(texts, work, packed_schema)
    dealt = rows.repartition("k", "bucket").sortWithinPartitions("k", "bucket")
    return dealt.mapInArrow(_arrow(fold, schema), schema)


def _read(texts: DataFrame, pointers: DataFrame) -> DataFrame:
    """(lang, k, phrase, fp, lo, n) of pointers, the phrase read from the text."""
    few = pointers.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    at = F.substring(F.col("text").cast("binary"), (F.col("start") + 1).cast("int"), F.col("size").cast("int")).cast("string")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    phrase = F.regexp_replace(F.translate(at, upper, upper.lower()), "[ \t]+", " ")
    return texts.join(F.broadcast(pointers) if few else pointers, "row").select(
        "lang", "k", phrase.alias("phrase"), "fp", "lo", "n"
    )


def verified(phrases: DataFrame, bits: int) -> DataFrame:
    """``phrases`` as they are; fails if a phrase does not have the fingerprints it was counted under."""

    def run(batches):
        for batch in batches:
            k = batch.column("k").to_numpy()
            for i in np.unique(k[k > 0]):
                some = batch.filter(pa.array(k == i))
                grams = Grams(some.column("phrase"), some.column("lang"), bits, check=True)
                at = grams.at(int(i))
                same = len(at) == some.num_rows and np.array_equal(
                    grams.keys(at, int(i)).view(np.int64), some.column("fp").to_numpy()
                )
                if not same or not np.array_equal(grams.checks(at, int(i)), some.column("lo").to_numpy()):
                    raise ValueError("a phrase read at its pointer has other fingerprints than it was counted under")
            yield batch

    return phrases.mapInArrow(run, phrases.schema)


def recount(texts: DataFrame, shared: DataFrame, least: int, longest: int, bits: int) -> DataFrame:
    """(lang, k, phrase, n): the phrases of fingerprints that several phrases share, counted by text."""
    spark = texts.sparkSession
    place = F.shiftright("fp", _CUT).bitwiseAND(FILTER_BITS - 1)
    marks = spark.sparkContext.broadcast(_slim(bitmap(shared.select(place.alias("place")))))

    def work(batches):
        bits_set = _opened(marks.value)
        for batch in batches:
            grams = Grams(batch.column(2), batch.column(1), bits)
            langs = batch.column(1).to_pylist()
            counts: dict[tuple, int] = {}
            for k in range(1, longest + 1):
                at = grams.at(k)
                key = grams.keys(at, k)
                keep = listed(bits_set, key)
                for i, fp in zip(at[keep].tolist(), key[keep].view(np.int64).tolist(), strict=True):
                    one = (k, fp, langs[grams.row[i]], grams.text(i, k))
                    counts[one] = counts.get(one, 0) + 1
            if counts:
                ks, fps, of, text = zip(*counts, strict=True)
                yield {"k": ks, "fp": fps, "lang": of, "phrase": text, "n": list(counts.values())}

    rows = _pass(texts, work, "k int, fp long, lang string, phrase string, n long")
    counted = rows.join(shared.select("k", "fp"), ["k", "fp"], "left_semi").groupBy("lang", "k", "phrase")
    return counted.agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def frequent_phrases(
    docs: DataFrame, *, least: int = 100, longest: int = 5, column: str = "text", lang: str = "lang", bits: int = 64
) -> tuple[DataFrame, DataFrame]:
    """Phrases (lang, k, phrase, a) of up to ``longest`` words that stand ``least`` times, and words (lang, n) in all.

    ``bits`` narrows the fingerprints, to test what happens when phrases share one.
    """
    spark: SparkSession = docs.sparkSession
    named = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(column), F.lit("")).alias("text"),
    )
    texts = stage(named, "phrase-texts")
    frequent: dict[int, np.ndarray] = {}
    for k in range(1, longest + 1):
        sent = spark.sparkContext.broadcast({x: held for x, held in frequent.items() if x == k - 1})
        found = bitmap(count(texts, k, sent, bits, least))
        sent.destroy()
        if not found.any():
            break
        frequent[k] = _slim(found)
    sent = spark.sparkContext.broadcast(frequent)
    counted = stage(pointed(texts, longest, sent, bits, least), "phrase-counts")
    sent.destroy()
    one = (F.col("lo") == F.col("hi")) | (F.col("k") == 0)
    read = verified(_read(texts, counted.filter(one)), bits).select("lang", "k", "phrase", "n")
    shared = counted.filter(~one)
    if not shared.isEmpty():
        read = read.unionByName(recount(texts, shared, least, longest, bits).select("lang", "k", "phrase", "n"))
    read = stage(read, "phrases")
    totals = read.filter("k = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    return read.filter("k > 0").withColumnRenamed("n", "a"), totals


def collocations(phrases: DataFrame, totals: DataFrame, *, top: int = 2000) -> DataFrame:
    """Each language's ``top`` phrases of two words and more by their weakest cut.

    A phrase inside a longer one that is as frequent is dropped. Counts are multiplied and divided as whole numbers of
    up to 38 digits.
    """
    word = F.split("phrase", " ", -1)
    part = lambda first, size: F.array_join(F.slice(F.col("word"), first, size), " ")
    parted = phrases.filter("k > 1").withColumn("word", word)
    cut = parted.select("lang", "phrase", "a", "word", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cut = cut.select(
        "lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("first"),
        part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"),
    )
    left = phrases.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    exact = "cast({} as decimal(38,0))".format
    score = F.expr(
        f"cast((cast(1000 as decimal(4,0)) * cast(a as decimal(16,0)) * cast(n as decimal(16,0)))"
        f" div {exact('cast(l as decimal(18,0)) * cast(r as decimal(18,0))')} as bigint)"
    )
    scored = cut.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals, "lang")
    weakest = scored.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(
        F.min(F.struct("score", "cut", "l", "r")).alias("w")
    )
    inner = parted.filter("k > 2").select(
        "lang", "a", "word", "k", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size")
    )
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)))
    inside = inner.select("lang", part(F.col("at"), F.col("size")).alias("phrase"), F.col("a").alias("longer"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = weakest.join(inside, ["lang", "phrase"], "left").filter("longer is null or longer < a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    flat = kept.select("lang", "phrase", "a", "w.l", "w.r", "n", "w.score")
    ranked = flat.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame, *, least: int = 100, longest: int = 5, top: int = 2000, **options) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's ``top`` collocations of 2 to ``longest`` words."""
    return collocations(*frequent_phrases(docs, least=least, longest=longest, **options), top=top)
