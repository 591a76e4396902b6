"""Exact repeated passages: bytes covered by a string of ``LENGTH`` bytes that starts at another place as well.

A suffix array sorts every suffix; here only suffixes that can repeat are sorted, and only as deep as ``LENGTH``:

1. Initial q-gram buckets. Of the q-grams in each stretch of ``LENGTH`` bytes the one with the smallest hash is an
   anchor (the last of equals), so two equal stretches have the same anchor at the same distance. Anchors with the same
   q-gram form a bucket; a bucket of one anchor has no repeat. Tasks count before they send.
2. Anchors whose whole surroundings are equal are one class of the bucket; all stretches over them repeat.
3. Bucket-pointer refinement of what is left. The surroundings of a bucket's classes are aligned at the anchor. First
   the blocks of 25 bytes next to the anchor are refined outwards; a class whose equal neighbours on both sides cannot
   add up to 400 bytes is done. Then each offset that is left gets the bucket number of its 25 bytes; sorting on this number and the one 25 bytes later gives the bucket
   numbers of 50 bytes, and these in turn those of 100, 200 and 400. Offsets alone in their bucket drop out at once.
   Where a bucket of 400 bytes has two members, the stretch repeats.

Buckets of more than ``MEMBERS`` classes are not gathered: their stretches are counted by hash instead, which any
number of tasks can share. All of it judges the input, never what is left after removals.

Texts are UTF-8 bytes; a null text is empty. Matches never cross rows. Rows that repeat an id count as documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.staging import stage
from tillroll.llm.text import BYTE_VALUES, ODD, mixed, powers, rolling, slices, span_hash, tidy, utf8

LENGTH, GRAM, STEP = 400, 32, 25
#: q-grams in a stretch; also how far before its anchor a stretch can begin.
CHOICES = LENGTH - GRAM + 1
REACH = CHOICES - 1
AROUND = REACH + LENGTH
MEMBERS = 40_000
#: Classes whose reach is bounded together, and classes that are refined together.
BOUNDED, TOGETHER = 2_000, 4_000
#: A table of so many document keys may be broadcast.
BROADCAST_ROWS = 1_000_000
#: Bytes whose hashes are held at once.
PIECE = 1 << 20

_U = np.uint64
_PLACE = 27
_MASK = _U((1 << _PLACE) - 1)


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours, by minima that run through blocks from both sides."""
    n = len(values)
    if n < width:
        return values[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, bounds: np.ndarray):
    """Text number, place in the text, bucket (q-gram hash) and class (hash of the surroundings) of every anchor."""
    found = []
    for at in range(0, max(1, len(data) - LENGTH + 1), PIECE):
        low, high = max(0, at - LENGTH), min(len(data), at + PIECE + AROUND + LENGTH)
        piece = data[low:high]
        if len(piece) < LENGTH:
            continue
        sums = rolling(piece)
        place = np.arange(len(piece) - GRAM + 1)
        gram = span_hash(sums, place, place + GRAM)
        key = (gram & ~_MASK) | (_MASK - place.astype(_U))
        best = sliding_minimum(key, CHOICES)
        start = np.arange(at - low, min(at - low + PIECE, len(piece) - LENGTH + 1))
        text = np.searchsorted(bounds, start + low, "right") - 1
        inside = start + low + LENGTH <= bounds[text + 1]
        chosen = np.unique((_MASK - (best[start[inside]] & _MASK)).astype(np.int64))
        text = np.searchsorted(bounds, chosen + low, "right") - 1
        left = np.minimum(chosen + low - bounds[text], REACH)
        right = np.minimum(bounds[text + 1] - chosen - low, LENGTH)
        around = span_hash(sums, chosen - left, chosen + right)
        kind = mixed(around ^ (left * 1024 + right).astype(_U))
        found.append(np.stack([text, chosen + low - bounds[text], gram[chosen].view(np.int64), kind.view(np.int64)]))
    if not found:
        return np.empty((4, 0), np.int64)
    every = np.concatenate(found, axis=1)
    _, once = np.unique(every[:2], axis=1, return_index=True)  # pieces may find the same anchor
    return every[:, once]


def _numbered(key: np.ndarray) -> np.ndarray:
    """Bucket numbers of equal keys, -1 for a key of its own."""
    _, number, count = np.unique(key, return_inverse=True, return_counts=True)
    return np.where(count[number] > 1, number, -1).astype(np.int32)


def _aligned(around: list[bytes], left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The surroundings as rows of a grid with the anchors in one column; where each begins and ends."""
    grid = np.zeros((len(around), AROUND), np.uint8)
    first = REACH - left
    last = first + np.array([len(text) for text in around], np.int64)
    for i, text in enumerate(around):
        grid[i, first[i] : last[i]] = np.frombuffer(text, np.uint8)
    return grid, first, last


def _grams(grid: np.ndarray, rows: np.ndarray, j: int) -> np.ndarray:
    """Hash of the ``STEP`` bytes from offset ``j`` of some rows."""
    return mixed((BYTE_VALUES[grid[rows, j : j + STEP]] * powers(ODD, STEP)).sum(axis=1, dtype=_U))


def bounded(grid: np.ndarray, first: np.ndarray, last: np.ndarray, bucket: np.ndarray):
    """The first and last offset at which a repeated stretch of each member can begin (none if first > last).

    Blocks next to the anchor are refined outwards: a member keeps its number while others share all blocks so far.
    """
    m = len(grid)
    ends = []
    for direction in (-1, 1):
        number, edge = _numbered(mixed(bucket.astype(_U))), np.full(m, REACH if direction < 0 else LENGTH - STEP)
        edge += STEP if direction > 0 else 0
        at = REACH
        while True:
            low = at - STEP if direction < 0 else at
            if low < 0 or low + STEP > AROUND:
                break
            alive = np.flatnonzero((number >= 0) & (low >= first) & (low + STEP <= last))
            fresh = np.full(m, -1, np.int32)
            if len(alive) > 1:
                fresh[alive] = _numbered(mixed(_grams(grid, alive, low) ^ mixed(number[alive].astype(_U))))
            number = fresh
            if not (number >= 0).any():
                break
            at += direction * STEP
            edge[number >= 0] = at
        ends.append(edge)
    lowest = np.maximum(first, ends[0] - STEP + 1)
    highest = np.minimum(last, np.maximum(ends[1], REACH) + STEP - 1) - LENGTH
    return np.maximum(lowest, 0), np.minimum(highest, REACH)


def refine(grid: np.ndarray, low: np.ndarray, high: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Whether the stretch that begins at offset j repeats in the bucket: [j, member]; j is from low to high."""
    m, columns, own = len(grid), AROUND - STEP + 1, mixed(bucket.astype(_U))
    number = np.full((columns, m), -1, np.int32)
    for j in range(columns):
        asked = np.flatnonzero((low <= j) & (j <= high + LENGTH - STEP))
        if len(asked) > 1:
            number[j, asked] = _numbered(_grams(grid, asked, j) ^ own[asked])
    size = STEP
    while size < LENGTH:
        columns -= size
        for j in range(columns):
            here, later = number[j], number[j + size]
            both = np.flatnonzero((here >= 0) & (later >= 0))
            fresh = np.full(m, -1, np.int32)
            if len(both) > 1:
                fresh[both] = _numbered(here[both].astype(np.int64) * (m + 1) + later[both])
            number[j] = fresh
        size *= 2
    return number[:CHOICES] >= 0


def covered(repeats: np.ndarray) -> list[bytes]:
    """For each member the merged stretches, relative to the anchor, as pairs of int32."""
    found = []
    for row in repeats.T:
        starts = np.flatnonzero(row)
        if not len(starts):
            found.append(b"")
            continue
        gap = np.flatnonzero(np.diff(starts) > LENGTH)
        first = starts[np.concatenate([[0], gap + 1])] - REACH
        last = starts[np.concatenate([gap, [len(starts) - 1]])] - REACH + LENGTH
        found.append(np.stack([first, last], axis=1).astype(np.int32).tobytes())
    return found


def _documents(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.xxhash64("doc_id", text).alias("doc"), text.alias("text"))


def _anchors(documents: DataFrame) -> DataFrame:
    def run(batches):
        for batch in slices(batches, 1):
            data, bounds = utf8(batch.column(1))
            text, place, gram, kind = anchors(data, bounds)
            doc = batch.column(0).to_numpy()[text]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (gram, kind, doc, place)], names=["bucket", "kind", "doc", "place"]
            )

    return documents.select("doc", "text").mapInArrow(tidy(run), "bucket long, kind long, doc long, place long")


def _only(documents: DataFrame, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """The documents with (or, by ``left_anti``, without) one of the keys, before any shuffle if the keys are few."""
    return documents.join(F.broadcast(keys.select("doc")), "doc", how) if _few(keys) else documents


def _few(keys: DataFrame) -> bool:
    return keys.count() <= BROADCAST_ROWS


def _surroundings(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes around each wanted anchor (bucket, kind, doc, place) and how many of them lie before it."""
    asked = wanted.groupBy("doc").agg(F.collect_list(F.struct("bucket", "kind", "place")).alias("asked"))
    asked = stage(asked, "anchors-asked")

    def run(batches):
        for batch in slices(batches, 0):
            bucket, kind, left, around = [], [], [], []
            texts, rows = batch.column(0).to_pylist(), batch.column(1)
            for i, text in enumerate(texts):
                raw = text.encode()
                for x in rows[i].as_py():
                    before = min(x["place"], REACH)
                    bucket.append(x["bucket"])
                    kind.append(x["kind"])
                    left.append(before)
                    around.append(raw[x["place"] - before : x["place"] + LENGTH])
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket, pa.int64()), pa.array(kind, pa.int64()), pa.array(left, pa.int32()),
                 pa.array(around, pa.binary())],
                names=["bucket", "kind", "before", "around"],
            )

    return _only(documents, asked).join(asked, "doc").select("text", "asked").mapInArrow(
        tidy(run), "bucket long, kind long, before int, around binary"
    )


def _refined(around: DataFrame) -> DataFrame:
    """bucket, kind and the repeated stretches relative to the anchor; whole buckets meet in one task."""
    n = int(around.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = around.repartition(n, "bucket").sortWithinPartitions("bucket", "kind")

    def bound(rows):
        bucket = np.array([r[0] for r in rows], np.int64)
        grid, first, last = _aligned([r[3] for r in rows], np.array([r[2] for r in rows], np.int64))
        low, high = bounded(grid, first, last, bucket)
        kept = np.flatnonzero(low <= high)
        kind = np.array([r[1] for r in rows], np.int64)
        return [x[kept] for x in (bucket, kind, grid, low, high)]

    def out(parts):
        bucket, kind, grid, low, high = (np.concatenate(x) for x in zip(*parts, strict=True))
        found = covered(refine(grid, low, high, bucket))
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket), pa.array(kind), pa.array(found, pa.binary())], names=["bucket", "kind", "stretches"]
        )

    def run(batches):
        rows, parts, held = [], [], 0
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for row in zip(*columns, strict=True):
                if rows and row[:2] == rows[-1][:2]:
                    continue  # the same class from a repeated document
                if len(rows) >= BOUNDED and row[0] != rows[-1][0]:
                    parts.append(bound(rows))
                    held += len(parts[-1][0])
                    rows = []
                    if held >= TOGETHER:
                        yield out(parts)
                        parts, held = [], 0
                rows.append(row)
        if rows:
            parts.append(bound(rows))
            yield out(parts)

    return dealt.mapInArrow(tidy(run), "bucket long, kind long, stretches binary")


def _counted(around: DataFrame) -> DataFrame:
    """The same as ``_refined`` for buckets too large to gather: stretches are counted by hash."""

    def every(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                data, bounds = utf8(part.column(3).cast(pa.large_binary()).view(pa.large_string()))
                size = np.maximum(np.diff(bounds) - LENGTH + 1, 0)
                owner = np.repeat(np.arange(len(size)), size)
                offset = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
                start = bounds[:-1][owner] + offset
                value = span_hash(rolling(data), start, start + LENGTH)
                bucket, kind, left = (part.column(j).to_numpy() for j in (0, 1, 2))
                begin = offset - left[owner]
                use = (begin <= 0) & (begin >= -REACH)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[owner][use]), pa.array(kind[owner][use]), pa.array(begin[use].astype(np.int32)),
                     pa.array(value[use].view(np.int64))],
                    names=["bucket", "kind", "begin", "value"],
                )

    rows = stage(around.mapInArrow(tidy(every), "bucket long, kind long, begin int, value long").distinct(), "stretches")
    keys = ["bucket", "begin", "value"]
    repeated = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(*keys)
    starts = rows.join(repeated, keys).groupBy("bucket", "kind").agg(F.sort_array(F.collect_list("begin")).alias("begin"))

    def merge(batches):
        for batch in batches:
            held = []
            for begins in batch.column(2).to_pylist():
                row = np.zeros((CHOICES, 1), bool)
                row[np.array(begins) + REACH] = True
                held += covered(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(held, pa.binary())], names=["bucket", "kind", "stretches"]
            )

    return starts.mapInArrow(tidy(merge), "bucket long, kind long, stretches binary")


def repeated_stretches(documents: DataFrame) -> DataFrame:
    """doc and the repeated stretches of its text: pairs (from, to) of byte places, in no order, not merged."""
    found = stage(_anchors(documents), "anchors")
    kinds = found.groupBy("bucket", "kind").agg(
        F.count("*").alias("n"), F.min("doc").alias("doc"), F.expr("min_by(place, doc)").alias("place")
    )
    buckets = kinds.groupBy("bucket").agg(F.sum("n").alias("total"), F.count("*").alias("classes")).filter("total > 1")
    kinds = stage(kinds.join(buckets, "bucket"), "anchor-classes")
    unequal = kinds.filter("classes > 1")
    around = lambda df: _surroundings(documents, df.select("bucket", "kind", "doc", "place"))
    parts = _refined(around(unequal.filter(F.col("classes") <= MEMBERS)))
    large = unequal.filter(F.col("classes") > MEMBERS)
    if not large.isEmpty():
        parts = parts.union(_counted(around(large)))
    ends = np.array([-REACH, LENGTH], np.int32).tobytes()
    whole = kinds.filter("n > 1").select("bucket", "kind", F.lit(ends).alias("stretches"))
    alone = kinds.filter("n = 1").select("bucket", "kind")
    parts = parts.filter("length(stretches) > 0").join(alone, ["bucket", "kind"], "left_semi")
    marked = found.join(whole.union(parts), ["bucket", "kind"])
    return marked.groupBy("doc").agg(F.collect_list(F.struct("place", "stretches")).alias("found"))


def merged(found, size: int) -> list[tuple[int, int]]:
    """Maximal runs (from, to) of the stretches around the anchors, within the text."""
    pairs = [(max(0, x["place"] + a), min(size, x["place"] + b)) for x in found or ()
             for a, b in np.frombuffer(x["stretches"], np.int32).reshape(-1, 2).tolist()]
    runs = []
    for a, b in sorted(pairs):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return [tuple(run) for run in runs]


def remove(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, the removed ``runs`` (byte places) and the ``kept`` bytes of every document."""
    documents = _documents(docs)
    found = stage(repeated_stretches(documents), "stretches-found")

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in slices(batches, 1):
            size, runs, kept = [], [], []
            for text, marks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw, at, rest = text.encode(), 0, []
                spans = merged(marks, len(raw))
                for a, b in spans:
                    rest.append(raw[at:a])
                    at = b
                size.append(len(raw))
                runs.append([{"start": a, "end": b} for a, b in spans])
                kept.append(b"".join([*rest, raw[at:]]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "runs", "kept"],
            )

    columns = ["doc_id", "text", "found"]
    if _few(found):
        joined = _only(documents, found).join(found, "doc").select(*columns)
        clean = _only(documents, found, "left_anti").withColumn("found", F.lit(None).cast(found.schema["found"].dataType))
        joined = joined.union(clean.select(*columns))
    else:
        joined = documents.join(found, "doc", "left").select(*columns)
    return joined.mapInArrow(tidy(run), "doc_id long, n_bytes long, runs array<struct<start:long,end:long>>, kept binary")


def digest(docs: DataFrame) -> DataFrame:
    total = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return remove(docs).select(
        "doc_id",
        "n_bytes",
        total.alias("n_removed"),
        F.size("runs").cast("long").alias("n_spans"),
        F.lower(F.sha2("kept", 256)).alias("kept_sha256"),
    )

