"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures, then exact sorted-array intersection.

A document's set holds its distinct word shingles (64-bit hashes). Two sets link when their Jaccard similarity reaches
``PERCENT``; the result is the components of the links. No link is lost:

1. Equal sets are one set from here on (``sid``, a fingerprint); copies are never paired.
2. With every set in hash order, two linked sets share at least ``need`` shingles among their first ones (prefix
   filter for more than one common element). Prefix shingles are dealt by hash, counted per task first, and a set
   stays only if enough of its prefix occurs in other sets. Most sets of a corpus end here.
3. Each remaining set is compared with one leader that shares its smallest shingles: the set with the largest part of
   its prefix in other sets, which is the least edited of a family. Verified links give first components, so that large
   groups of near copies are not compared pair by pair.
4. Remaining links run between components. Shingles are ordered with the very common ones last; sets with a common
   prefix shingle meet in tiles: sorted by size, cut into blocks, and only blocks whose sizes can reach the similarity
   meet. In a tile, the bits in which two parity bitmaps differ bound the overlap from above; pairs that pass meet
   wider bitmaps, then the exact intersection of their arrays: first each set's most promising pair, then those that
   still lie in different components.

What the driver gets is bounded: the very common shingles (at most ``COMMON_SHARE`` times a mean set size).
A null text or one without words has an empty set and links with nothing. Rows without a doc_id take no part; rows
that repeat an id each get a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.staging import stage
from tillroll.llm.components import components
from tillroll.llm.text import mixed, packed, shingle_sets, slices, tidy, unpacked

PERCENT = 75
#: Shingles of a set that must be shared in the first filter: one in so many.
SHARED_PART = 5
#: Smallest shingles by which a set finds its leader.
LEADER_KEYS = 16
#: A shingle is very common if more than one in so many of the remaining sets has it, and LEAST_COMMON at least.
COMMON_SHARE, LEAST_COMMON = 2_000, 64
#: Sets on each side of a tile.
TILE = 256
#: Postings a task gathers before it hands them on.
GATHERED = 1 << 19
#: A table of pairs of this many rows (16 bytes each) may be broadcast.
BROADCAST_ROWS = 300_000

_U = np.uint64


def least_overlap(n):
    """Common shingles that a set of size ``n`` needs with any set it links with."""
    return (PERCENT * n + 99) // 100


def shared_prefix(n):
    return np.minimum(n, n - least_overlap(n) + (n + SHARED_PART - 1) // SHARED_PART)


def shared_need(n):
    return (least_overlap(n) + SHARED_PART - 1) // SHARED_PART


def linked(common, a, b):
    return 100 * common >= PERCENT * (a + b - common)


def fingerprints(shingle: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One number per set, from the sum of its hashes mixed anew and its size."""
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(mixed(shingle ^ _U(0x5851F42D4C957F2D)), dtype=_U)])
    size = (bounds[1:] - bounds[:-1]).astype(_U)
    return mixed(sums[bounds[1:]] - sums[bounds[:-1]] + size * _U(0x9E3779B97F4A7C15))


def heads(bounds: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first ``size`` entries of each stretch, and the number of the stretch."""
    owner = np.repeat(np.arange(len(size)), size)
    first = np.concatenate([[0], np.cumsum(size)])[:-1]
    return bounds[:-1][owner] + np.arange(len(owner)) - first[owner], owner


def bitmaps(shingle: np.ndarray, bounds: np.ndarray, times: int = 1) -> list[bytes]:
    """Parity bitmaps by the lowest hash bits, ``times`` as wide as the power of two at or above the size (and 64)."""
    found = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        width = times * max(64, 1 << int(b - a - 1).bit_length()) if b > a else 64
        odd = np.bincount((shingle[a:b] & _U(width - 1)).astype(np.int64), minlength=width) & 1
        found.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
    return found


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """A parity bitmap (bytes) brought down to a smaller width."""
    while bits.shape[-1] > width:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def _six(values: np.ndarray) -> np.ndarray:
    """The upper six bytes of each hash, enough to tell shingles apart where only sharing matters."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, 2:])


def _eight(raw: bytes) -> np.ndarray:
    part = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return np.ascontiguousarray(np.pad(part, ((0, 0), (2, 0)))).view(_U).ravel()


def _by_bucket(bucket: np.ndarray, buckets: int, **arrays: np.ndarray):
    """A row per bucket with its part of each array as bytes; arrays are dealt by ``bucket``."""
    order = np.argsort(bucket, kind="stable")
    at = np.searchsorted(bucket[order], np.arange(buckets + 1))
    some = np.flatnonzero(at[1:] > at[:-1])
    held = {name: value[order] for name, value in arrays.items()}
    return some, {name: [value[at[i] : at[i + 1]].tobytes() for i in some] for name, value in held.items()}


def _buckets(df: DataFrame) -> int:
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _dealt(df: DataFrame) -> DataFrame:
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bucket")


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of the sorted ``keys`` begins, with the end as the last entry."""
    fresh = np.ones(len(keys[0]) + 1, bool)
    fresh[1:-1] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(fresh)


# 1 and 2: sets, and how much of each prefix is shared


def _facts(docs: DataFrame) -> DataFrame:
    """Rows of two kinds: kind 0 is a document (doc_id, sid, size), kind 1 a set's short id and a count of shared
    prefix shingles.

    One shuffle of prefix shingles. A task sends a shingle that several of its sets hold once, marked as shared, and
    counts it for those sets itself; so a shingle that all documents hold is one row per task.
    """
    buckets = _buckets(docs)

    def deal(batches):
        def handed_on(shingles, ids, doc_rows):
            token, sid = np.concatenate(shingles), np.concatenate(ids)
            order = np.lexsort((sid, token))
            token, sid = token[order], sid[order]
            runs = _runs(token)
            size = runs[1:] - runs[:-1]
            several = np.repeat(size > 1, size)
            own, count = np.unique(sid[several], return_counts=True)
            shared = token[runs[:-1][size > 1]]
            nobody = np.zeros(len(shared), np.uint32)
            for what, values, owner in ((0, token[~several], sid[~several]), (1, shared, nobody)):
                spread = (values >> _U(32)) % _U(buckets)
                some, held = _by_bucket(spread.astype(np.int64), buckets, token=_six(values), sid=owner)
                yield some, what, held["token"], held["sid"]
            spread = own.astype(np.int64) % buckets
            some, held = _by_bucket(spread, buckets, count=count.astype(np.int64), sid=own)
            yield some, 2, held["count"], held["sid"]
            rows = np.concatenate(doc_rows)
            some, held = _by_bucket(mixed(rows[:, 0].view(_U)).astype(np.int64) % buckets, buckets, rows=rows)
            yield some, 3, held["rows"], [b""] * len(some)

        def out(parts):
            for some, what, left, right in parts:
                if len(some):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(some, pa.int32()), pa.array(np.full(len(some), what), pa.int32()),
                         pa.array(left, pa.binary()), pa.array(right, pa.binary())],
                        names=["bucket", "what", "left", "right"],
                    )

        shingles, ids, doc_rows, total, seen = [], [], [], 0, np.empty(0, _U)
        for batch in slices(batches, 1):
            shingle, bounds = shingle_sets(batch.column(1))
            size = bounds[1:] - bounds[:-1]
            sid = fingerprints(shingle, bounds)
            doc_id = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            doc_rows.append(np.stack([doc_id, sid.view(np.int64), size], axis=1))
            _, first = np.unique(sid, return_index=True)
            fresh = np.zeros(len(sid), bool)
            fresh[first] = True
            fresh &= ~np.isin(sid, seen)
            seen = np.concatenate([seen, sid[fresh]])
            at, owner = heads(bounds, np.where(fresh, shared_prefix(size), 0))
            shingles.append(shingle[at])
            ids.append((sid[owner] >> _U(32)).astype(np.uint32))
            total += len(at)
            if total > GATHERED:
                yield from out(handed_on(shingles, ids, doc_rows))
                shingles, ids, doc_rows, total, seen = [], [], [], 0, np.empty(0, _U)
        if doc_rows:
            yield from out(handed_on(shingles, ids, doc_rows))

    def count(batches):
        token, sid, marked = [np.empty(0, _U)], [np.empty(0, np.uint32)], [np.empty(0, _U)]
        names = ["kind", "x", "y", "n"]

        def rows(kind, x, y, n):
            arrays = [pa.array(np.full(len(x), kind), pa.int32()), *(pa.array(v, pa.int64()) for v in (x, y, n))]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in (1, 2, 3)]
            for what, left, right in zip(*columns, strict=True):
                if what == 3:
                    docs_of = np.frombuffer(left, np.int64).reshape(-1, 3)
                    yield rows(0, docs_of[:, 0], docs_of[:, 1], docs_of[:, 2])
                elif what == 2:
                    owner = np.frombuffer(right, np.uint32).astype(np.int64)
                    yield rows(1, owner, np.zeros_like(owner), np.frombuffer(left, np.int64))
                elif what == 1:
                    marked.append(_eight(left))
                else:
                    token.append(_eight(left))
                    sid.append(np.frombuffer(right, np.uint32))
        token, sid, marked = np.concatenate(token), np.concatenate(sid), np.unique(np.concatenate(marked))
        order = np.lexsort((sid, token))
        token, sid = token[order], sid[order]
        once = _runs(token, sid)[:-1]
        token, sid = token[once], sid[once]
        runs = _runs(token)
        size = runs[1:] - runs[:-1]
        known = np.zeros(len(token), bool)
        if len(marked) and len(token):
            at = np.minimum(np.searchsorted(marked, token), len(marked) - 1)
            known = marked[at] == token
        own, n = np.unique(sid[np.repeat(size > 1, size) | known], return_counts=True)
        yield rows(1, own.astype(np.int64), np.zeros(len(own), np.int64), n)

    dealt = docs.select("doc_id", "text").mapInArrow(tidy(deal), "bucket int, what int, left binary, right binary")
    return _dealt(dealt).mapInArrow(tidy(count), "kind int, x long, y long, n long")


# 3 and 4: links between the remaining sets


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of sets those that link, by intersection of the sorted arrays.

    Each pair's first set travels to its second; a set with very many partners is sent to several tasks.
    """
    spark = pairs.sparkSession
    pairs = stage(pairs, "set-pairs")
    small = F.broadcast if pairs.count() <= BROADCAST_ROWS else lambda df: df
    share = 200
    copies = pairs.groupBy("b").agg((F.floor(F.count("*") / share) + 1).alias("copies"))
    own = sets.join(small(copies), sets.sid == copies.b).select(
        "b", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)).alias("part"),
        F.lit(None).cast("long").alias("a"), "elements",
    )
    salted = pairs.join(copies, "b").select(
        "a", "b", F.pmod(F.xxhash64("a"), F.col("copies")).cast("int").alias("part")
    )
    other = sets.join(small(salted), sets.sid == salted.a).select("b", "part", "a", "elements")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = own.union(other).repartition(n, "b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())

    def compare(batches):
        held = np.empty(0, _U)
        for batch in batches:
            links = []
            columns = (batch.column(i).to_pylist() for i in (0, 2, 3))
            for b, a, elements in zip(*columns, strict=True):
                values = np.frombuffer(elements, _U)
                if a is None:
                    held = values
                    continue
                common = len(held) + len(values) - len(np.union1d(held, values))
                if linked(common, len(held), len(values)):
                    links.append((a, b))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"]
            )

    return met.mapInArrow(tidy(compare), "a long, b long")


def promising(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those that wide bitmaps let pass, with the similarity they allow at most."""
    pairs = stage(pairs, "bounded-pairs")
    small = F.broadcast if pairs.count() <= BROADCAST_ROWS else lambda df: df
    side = lambda x: sets.select(F.col("sid").alias(x), F.col("size").alias(f"n{x}"), F.col("wide").alias(f"w{x}"))
    # the pairs may be broadcast, never the bitmaps, whose size grows with the sets
    met = side("b").join(side("a").join(small(pairs), "a"), "b").select("a", "b", "na", "nb", "wa", "wb")

    def run(batches):
        for batch in batches:
            size, held, found = [batch.column(i).to_numpy() for i in (2, 3)], [], []
            bits = [[np.frombuffer(x, np.uint8) for x in batch.column(i).to_pylist()] for i in (4, 5)]
            for i, (x, y) in enumerate(zip(*bits, strict=True)):
                width = min(len(x), len(y))
                differ = int(np.bitwise_count(folded(x, width) ^ folded(y, width)).sum())
                a, b = int(size[0][i]), int(size[1][i])
                most = min(a, b, (a + b - differ) // 2)
                if linked(most, a, b):
                    held.append(i)
                    found.append(most / (a + b - most))
            kept = batch.select(["a", "b"]).take(pa.array(held, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(found, pa.float64())], names=["a", "b", "similarity"]
            )

    return met.mapInArrow(tidy(run), "a long, b long, similarity double")


def _leaders(sets: DataFrame) -> DataFrame:
    """Each set with the set that is the best holder of most of its first shingles."""

    def keys(batches):
        for batch in batches:
            shingle, bounds = unpacked(batch.column(2), _U)
            at, owner = heads(bounds, np.minimum(bounds[1:] - bounds[:-1], LEADER_KEYS))
            yield pa.RecordBatch.from_arrays(
                [pa.array(shingle[at].view(np.int64)), *(batch.column(i).take(pa.array(owner)) for i in (0, 1))],
                names=["key", "sid", "alone"],
            )

    own = sets.select("sid", "alone", "elements")
    key = stage(own.mapInArrow(tidy(keys), "key long, sid long, alone double"), "leader-keys")
    least = key.groupBy("key").agg(F.min(F.struct("alone", "sid"))["sid"].alias("leader"))
    both = key.join(least, "key").filter("leader <> sid").groupBy("sid", "leader").agg(F.count("*").alias("n"))
    best = both.groupBy("sid").agg(F.max("n").alias("n"))
    return (
        both.join(best, ["sid", "n"])
        .groupBy("sid").agg(F.min("leader").alias("leader"))
        .select(F.col("sid").alias("a"), F.col("leader").alias("b"))
    )


def _common_shingles(sets: DataFrame, least: int) -> np.ndarray:
    """Shingles that ``least`` sets hold or more; tasks count before they send."""
    buckets = _buckets(sets)

    def deal(batches):
        def handed_on(parts):
            token, n = np.unique(np.concatenate(parts), return_counts=True)
            spread = ((token >> _U(32)) % _U(buckets)).astype(np.int64)
            some, held = _by_bucket(spread, buckets, token=_six(token), n=n.astype(np.int32))
            return pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), pa.array(held["token"], pa.binary()), pa.array(held["n"], pa.binary())],
                names=["bucket", "token", "n"],
            )

        parts, total = [], 0
        for batch in batches:
            parts.append(unpacked(batch.column(0), _U)[0])
            total += len(parts[-1])
            if total > GATHERED:
                yield handed_on(parts)
                parts, total = [], 0
        if total:
            yield handed_on(parts)

    def count(batches):
        token, n = [np.empty(0, _U)], [np.empty(0, np.int32)]
        for batch in batches:
            token += map(_eight, batch.column(1).to_pylist())
            n += (np.frombuffer(x, np.int32) for x in batch.column(2).to_pylist())
        key, which = np.unique(np.concatenate(token), return_inverse=True)
        total = np.bincount(which, np.concatenate(n), len(key))
        yield pa.RecordBatch.from_arrays([pa.array(key[total >= least].view(np.int64))], names=["token"])

    dealt = sets.select("elements").mapInArrow(tidy(deal), "bucket int, token binary, n binary")
    found = _dealt(dealt).mapInArrow(tidy(count), "token long").toArrow().column(0).to_numpy()
    return np.sort(found.astype(np.int64).view(_U))


def _between(sets: DataFrame, common: np.ndarray) -> DataFrame:
    """Pairs of sets of different components that share a prefix shingle and whose sizes can link, in blocks.

    A row is a pair of blocks (binary sid arrays); blocks of a short list are the list itself.
    """
    buckets = _buckets(sets)

    def deal(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sid, comp = (part.column(i).to_numpy() for i in (0, 1))
                shingle, bounds = unpacked(part.column(2), _U)
                size = bounds[1:] - bounds[:-1]
                owner = np.repeat(np.arange(len(size)), size)
                upper = shingle & ~_U(0xFFFF)
                place = np.minimum(np.searchsorted(common, upper), max(0, len(common) - 1))
                late = common[place] == upper if len(common) else np.zeros(len(shingle), bool)
                order = np.lexsort((shingle, late, owner))
                take, who = heads(bounds, size - least_overlap(size) + (size > 0))
                token = shingle[order[take]]
                spread = ((token >> _U(32)) % _U(buckets)).astype(np.int64)
                facts = np.stack([sid[who], comp[who], size[who]], axis=1)
                some, held = _by_bucket(spread, buckets, token=token, facts=facts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array(held["token"], pa.binary()),
                     pa.array(held["facts"], pa.binary())],
                    names=["bucket", "token", "facts"],
                )

    def meet(batches):
        token, facts = [np.empty(0, _U)], [np.empty((0, 3), np.int64)]
        for batch in batches:
            token += (np.frombuffer(x, _U) for x in batch.column(1).to_pylist())
            facts += (np.frombuffer(x, np.int64).reshape(-1, 3) for x in batch.column(2).to_pylist())
        token, facts = np.concatenate(token), np.concatenate(facts)
        order = np.lexsort((facts[:, 0], facts[:, 2], token))
        token, facts = token[order], facts[order]
        runs = _runs(token)
        if len(token):
            mixed_runs = np.maximum.reduceat(facts[:, 1], runs[:-1]) != np.minimum.reduceat(facts[:, 1], runs[:-1])
        else:
            mixed_runs = np.empty(0, bool)
        seen, left, right = set(), [], []
        for i in np.flatnonzero(mixed_runs):
            sid, size = facts[runs[i] : runs[i + 1], 0], facts[runs[i] : runs[i + 1], 2]
            name = (len(sid), sid.tobytes()) if len(sid) <= TILE else (len(sid), hash(sid.tobytes()))
            if name in seen:
                continue
            seen.add(name)
            blocks = range(0, len(sid), TILE)
            for a in blocks:
                for b in blocks:
                    # sorted by size: the smallest of the later block against the largest of the earlier one
                    if b >= a and 100 * size[min(a + TILE, len(sid)) - 1] >= PERCENT * size[b]:
                        left.append(sid[a : a + TILE].tobytes())
                        right.append(sid[b : b + TILE].tobytes())
            if len(left) > 2_000:
                yield tiles(left, right)
                left, right = [], []
        yield tiles(left, right)

    def tiles(left, right):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in (left, right)], names=["left", "right"])

    dealt = sets.select("sid", "root", "elements").mapInArrow(tidy(deal), "bucket int, token binary, facts binary")
    return _dealt(dealt).mapInArrow(tidy(meet), "left binary, right binary").distinct()


def _candidates(tiles: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of the tiles whose bitmaps leave enough overlap possible."""
    spark = tiles.sparkSession
    tiles = stage(tiles.withColumn("tile", F.xxhash64("left", "right")), "tiles")

    def members(batches):
        for batch in batches:
            tile = batch.column(0).to_numpy()
            (left, at), (right, of) = unpacked(batch.column(1), np.int64), unpacked(batch.column(2), np.int64)
            same = np.array([x == y for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)])
            for side, sid, bounds in ((0, left, at), (1, right, of)):
                owner = np.repeat(np.arange(len(tile)), bounds[1:] - bounds[:-1])
                use = ~same[owner] if side else np.ones(len(owner), bool)
                sides = np.where(same[owner], 2, side)[use]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tile[owner][use]), pa.array(sides, pa.int32()), pa.array(sid[use])],
                    names=["tile", "side", "sid"],
                )

    member = tiles.select("tile", "left", "right").mapInArrow(tidy(members), "tile long, side int, sid long")
    known = sets.select("sid", "root", "size", "bits")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = member.join(known, "sid").select("tile", "side", "sid", "root", "size", "bits")
    met = met.repartition(n, "tile").sortWithinPartitions("tile", "side")

    def compare(rows):
        sides = [sorted((r for r in rows if r[1] in (s, 2)), key=lambda r: r[4]) for s in (0, 1)]
        meta = [np.array([r[2:5] for r in side], np.int64).reshape(-1, 3) for side in sides]
        bits = [[np.frombuffer(r[5], np.uint8) for r in side] for side in sides]
        at_width: dict[int, np.ndarray] = {}  # the later side folded to a width, from the first set that is as wide
        found = []
        for i, own in enumerate(bits[0]):
            sid, root, size = meta[0][i]
            low = np.searchsorted(meta[1][:, 2], least_overlap(size))
            high = np.searchsorted(meta[1][:, 2], 100 * size // PERCENT, "right")
            if low >= high:
                continue
            width = min(len(own), len(bits[1][low]))
            if width not in at_width:
                at_width[width] = np.array(
                    [folded(x, width) if len(x) >= width else np.zeros(width, np.uint8) for x in bits[1]]
                )
            differ = np.bitwise_count(at_width[width][low:high] ^ folded(own, width)).sum(axis=1, dtype=np.int64)
            other = meta[1][low:high, 2]
            most = np.minimum((size + other - differ) // 2, np.minimum(size, other))
            ok = (meta[1][low:high, 1] != root) & linked(most, size, other)
            found += [(sid, x) for x in meta[1][low:high, 0][ok]]
        return found

    def bound(batches):
        """A pair that several tiles of a task propose leaves it once (or once per ``GATHERED`` pairs)."""

        def out(found):
            pairs = np.array(list(found), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, i].copy()) for i in (0, 1)], names=["a", "b"])

        rows, found = [], set()
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for row in zip(*columns, strict=True):
                if rows and rows[0][0] != row[0]:
                    found.update((max(pair), min(pair)) for pair in compare(rows))
                    rows = []
                    if len(found) > GATHERED:
                        yield out(found)
                        found = set()
                rows.append(row)
        if rows:
            found.update((max(pair), min(pair)) for pair in compare(rows))
        if found:
            yield out(found)

    return met.mapInArrow(tidy(bound), "a long, b long").distinct()


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every document."""
    docs = docs.filter("doc_id is not null")
    facts = stage(_facts(docs), "set-facts")
    rows = facts.filter("kind = 0").select(
        F.col("x").alias("doc_id"), F.col("y").alias("sid"), F.col("n").alias("n_shingles")
    )
    classes = stage(
        rows.filter("n_shingles > 0").groupBy("sid", "n_shingles").agg(F.min("doc_id").alias("rep")), "set-classes"
    )
    shared = facts.filter("kind = 1").groupBy(F.col("x").alias("short")).agg(F.sum("n").alias("shared"))
    size = F.col("n_shingles")
    least = F.floor((PERCENT * size + 99) / 100)
    kept = classes.withColumn("short", F.shiftrightunsigned("sid", 32)).join(shared, "short")
    kept = kept.filter(F.col("shared") >= F.floor((least + SHARED_PART - 1) / SHARED_PART))
    alone = F.greatest(F.lit(0.0), 1 - F.col("shared") / size).alias("alone")
    kept = stage(kept.select("sid", "rep", alone), "set-kept")
    n_kept = kept.count()
    small = F.broadcast if n_kept <= BROADCAST_ROWS else lambda df: df

    def gather(batches):
        for batch in slices(batches, 2):
            shingle, bounds = shingle_sets(batch.column(2))
            size = bounds[1:] - bounds[:-1]
            found = pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(size, pa.int64()), packed(shingle, bounds),
                 pa.array(bitmaps(shingle, bounds, 4), pa.binary()), pa.array(bitmaps(shingle, bounds, 16), pa.binary())],
                names=["sid", "alone", "size", "elements", "bits", "wide"],
            )
            # an id that several rows share may name another row's text
            yield found.filter(pa.array(fingerprints(shingle, bounds).view(np.int64) == batch.column(0).to_numpy()))

    whole = docs.select("doc_id", "text").join(small(kept), F.col("doc_id") == F.col("rep")).select("sid", "alone", "text")
    shape = "sid long, alone double, size long, elements binary, bits binary, wide binary"
    sets = stage(whole.mapInArrow(tidy(gather), shape), "sets")
    links = stage(verified(promising(_leaders(sets), sets).select("a", "b"), sets), "set-links")

    def rooted(links):
        found = stage(components(links).withColumnRenamed("node", "sid"), "set-roots")
        return small(found) if found.count() <= BROADCAST_ROWS else found

    def with_root(df, found, name="sid", root="root"):
        named = found.withColumnsRenamed({"sid": name, "root": root})
        return df.join(named, name, "left").withColumn(root, F.coalesce(root, name))

    grouped = with_root(sets, rooted(links))
    common = _common_shingles(sets, max(LEAST_COMMON, n_kept // COMMON_SHARE))
    pairs = stage(promising(_candidates(_between(grouped, common), grouped), sets), "set-candidates")
    best = pairs.groupBy("a").agg(F.max_by("b", "similarity").alias("b"))
    links = stage(links.union(verified(best, sets)), "set-links")
    found = rooted(links)
    apart = with_root(with_root(pairs, found, "a", "root_a"), found, "b", "root_b").filter("root_a <> root_b")
    root = components(links.union(verified(apart.select("a", "b"), sets)))
    rep = classes.join(root.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    smallest = rep.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_class = rep.join(smallest, "root").select("sid", "component_id")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.join(of_class, "sid", "left").select("doc_id", "n_shingles", own.alias("component_id"))
