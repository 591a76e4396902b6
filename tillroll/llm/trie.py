"""Prefix trie of conversations from padded turn-id matrices.

A turn's id is the first half of the SHA-256 of its role and text, so a conversation is a short row of ids. Rows are range
partitioned by their ids, then by conversation: a node of the trie, the conversations that share their first turns, is
then a stretch of rows that runs over one shard or several.

Within a shard the ids become matrices of ranks, padded at the end and ``WIDTH`` turns wide; ``lexsort`` orders the rows
block by block, and masks of changes from row to row, OR-accumulated along the columns, tell at which depth each row
leaves the one before (its common prefix). A row begins the nodes deeper than that, and ``reduceat`` over these
begins adds up every depth. All measures are sums over the rows of a node:

* children: rows that are longer than the node's depth and leave their predecessor at that depth or before;
* leaves: rows that the next row leaves before their end;
* saved bytes: of each row, the texts from the node's depth to where it leaves its predecessor.

Nodes that hold the first or the last row of a shard may go on in the neighbour. Their sums are sent as parts under
the digest of their path and added up; what the first and last row of two neighbours share is found from these rows
alone, and the sums that hang on it are added as parts, too. There are at most two such paths a shard.

A conversation's ids (16 bytes a turn) and text lengths stand in one row; its texts are not gathered.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.staging import stage
from tillroll.llm.text import tidy

#: Turns of a block of the matrix; bounds the padding, not the depth.
WIDTH = 16
#: Conversations in a shard, on average.
SHARD_ROWS = 50_000
#: Boundary nodes that are broadcast to name their children's parent; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Conversation ids in one row on their way to a digest.
CHUNK = 8192

_ID = 16
_NODES = (
    "kind int, shard int, at long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long,"
    " n_leaves long, saved_tokens long, key binary, parent binary, ends binary"
)
#: Kinds of rows: whole nodes, parts of nodes, first and last rows of shards, ids that end at a part.
_WHOLE, _PART, _FIRST, _LAST, _ENDS = range(5)
_NAMES = [part.split()[0] for part in _NODES.split(",")]


def ordered_turns(
    turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv_id, turns): per conversation its turns (id, bytes) in order.

    Turns are ordered by ``turn``, null first, ties by role and then by id (equal turns are alike). Null roles and texts are
    empty. Rows without a conversation take no part; other columns are not looked at.
    """
    said = F.coalesce(F.col(role), F.lit(""))
    words = F.coalesce(F.col(text), F.lit(""))
    # The length before the role keeps apart ("ab", "c") and ("a", "bc").
    whole = F.concat(F.octet_length(said).cast("string"), F.lit(":"), said, words)
    rows = turns.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"),
        F.struct(
            F.col(turn).cast("long").alias("turn"), said.alias("role"),
            F.left(F.sha2(whole.cast("binary"), 256), F.lit(2 * _ID)).alias("id"),
            F.octet_length(words).cast("long").alias("bytes"),
        ).alias("t"),
    )
    gathered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return gathered.select("conv_id", F.transform("t", lambda x: F.struct(x["id"], x["bytes"])).alias("turns"))


def branched(held: DataFrame, *, family: int = 5, most: int = 9) -> DataFrame:
    """Conversations rebuilt on the first of their family: its first h turns, then their own after their first h.

    The first of a family is ``conv_id - conv_id % family``, h is crc32 of the id in decimal, modulo ``most``. A first that is
    not there gives no turns.
    """
    known = held.select(
        "conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % family).alias("first"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int").alias("h"),
    )
    firsts = held.filter(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("first"), F.slice("turns", 1, most - 1).alias("begin")
    )
    none = F.slice("turns", 1, 0)
    begin = F.coalesce(F.slice("begin", F.lit(1), F.col("h")), none)
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return known.join(firsts, "first", "left").select("conv_id", F.concat(begin, own).alias("turns"))


class _Rows:
    """The conversations of a shard in lexicographic order, and how far each goes along with the one before."""

    def __init__(self, conv: np.ndarray, lens: np.ndarray, ids: np.ndarray, sizes: np.ndarray):
        offset = np.concatenate([[0], np.cumsum(lens)])
        parts = ids.view(">u8").astype(np.uint64).reshape(-1, 2)
        order = np.lexsort((parts[:, 1], parts[:, 0]))
        new = np.ones(len(order), bool)
        new[1:] = (parts[order][1:] != parts[order][:-1]).any(axis=1)
        rank = np.empty(len(order), np.int64)  # 1 and up, in the order of the ids; 0 pads
        rank[order] = np.cumsum(new)
        n = len(conv)
        rows, group, lcp = np.lexsort((conv, lens > 0)), np.zeros(n, np.int64), np.zeros(n, np.int64)
        todo = np.arange(n)  # places in the order that are not settled yet
        base = 0
        while len(todo):
            at = rows[todo]
            place = base + np.arange(WIDTH)
            there = place < lens[at][:, None]
            matrix = np.zeros((len(at), WIDTH), np.int64)
            matrix[there] = rank[(offset[at][:, None] + place)[there]]
            order = np.lexsort((conv[at], *matrix.T[::-1], group[todo]))
            at, matrix = at[order], matrix[order]
            rows[todo] = at
            change = np.ones((len(at), WIDTH + 1), bool)
            change[1:, 0] = group[todo][1:] != group[todo][:-1]
            change[1:, 1:] = matrix[1:] != matrix[:-1]
            parted = np.logical_or.accumulate(change, axis=1)
            shared = (~parted[:, 1:] & (matrix > 0)).sum(axis=1)
            along = ~parted[:, 0]
            lcp[todo[along]] = base + shared[along]
            group[todo] = np.cumsum(parted[:, -1])
            base += WIDTH
            # What is left are stretches of two rows and more that are alike so far, one of them longer.
            alike = ~parted[:, -1]
            several = alike.copy()
            several[:-1] |= alike[1:]
            begins = np.flatnonzero(~alike)
            longest = np.repeat(np.maximum.reduceat(lens[at], begins), np.diff(np.append(begins, len(at))))
            todo = todo[several & (longest > base)]
        self.conv, self.lens, self.lcp, self.n = conv[rows], lens[rows], lcp, n
        self.begin = offset[rows]
        self.ids = ids.reshape(-1, _ID)
        self.bytes = np.concatenate([[0], np.cumsum(sizes)])
        self.next = np.append(lcp[1:], np.iinfo(np.int64).max)  # what follows the last row is not known here

    def path(self, row: int) -> bytes:
        return self.ids[self.begin[row] : self.begin[row] + self.lens[row]].tobytes()

    def sizes(self, row: int) -> np.ndarray:
        at = self.begin[row]
        return np.diff(self.bytes[at : at + self.lens[row] + 1])


def _digests(path: bytes) -> list[bytes]:
    """The key of each node along a path, the root's first."""
    keys = [hashlib.sha256(b"").digest()]
    for at in range(0, len(path), _ID):
        keys.append(hashlib.sha256(keys[-1] + path[at : at + _ID]).digest())
    return keys


def _decimals(ids: np.ndarray) -> bytes:
    return ",".join(map(str, ids.tolist())).encode()


def _shard_nodes(rows: _Rows, shard: int):
    """Columns of the nodes of a shard, depth by depth, then its first and last row."""
    first, last = _digests(rows.path(0)), _digests(rows.path(rows.n - 1))
    active, depth = np.arange(rows.n), 0
    above = np.zeros(rows.n, np.int64)  # each row's node of the depth before: smallest member, and whether it is a part
    above_part = np.zeros(rows.n, np.int8)
    while len(active):
        lcp, lens, conv = rows.lcp[active], rows.lens[active], rows.conv[active]
        begins = np.flatnonzero(lcp < depth) if depth else np.zeros(1, np.int64)
        begins = begins if len(begins) and begins[0] == 0 else np.concatenate([[0], begins])
        ends = np.append(begins[1:], len(active))
        known = active > 0  # what precedes the first row is not known here
        members = ends - begins
        smallest = np.minimum.reduceat(conv, begins)
        children = np.add.reduceat((known & (lens > depth) & (lcp <= depth)).astype(np.int64), begins)
        leaves = np.add.reduceat((rows.next[active] < lens).astype(np.int64), begins)
        at = rows.begin[active]
        saved = rows.bytes[at + np.maximum(lcp, 0)] - rows.bytes[at + max(depth - 1, 0)]
        saved = np.add.reduceat(np.where(known & (lcp >= depth), saved, 0), begins)
        has_first = active[begins] == 0
        has_last = active[ends - 1] == rows.n - 1
        part = has_first | has_last
        count = len(begins)
        keys, parents, digest = [None] * count, [None] * count, [None] * count
        stop = np.add.reduceat((lens == depth).astype(np.int64), begins)  # they come first, by conversation
        for i in range(count):
            if part[i]:
                path = first if has_first[i] else last
                keys[i] = path[depth]
                parents[i] = path[depth - 1] if depth else None
            elif above_part[active[begins[i]]]:
                path = first if above_part[active[begins[i]]] == 1 else last
                parents[i] = path[depth - 1]
            if not part[i]:
                ended = conv[begins[i] : begins[i] + stop[i]]
                digest[i] = hashlib.sha256(_decimals(ended)).digest()
        over = above[active[begins]]
        yield {
            "kind": np.where(part, _PART, _WHOLE), "shard": [shard] * count, "at": [0] * count, "conv_id": smallest,
            "depth": [depth] * count,
            "parent_conv_id": [None if p is not None or depth == 0 else int(o) for p, o in zip(parents, over, strict=True)],
            "n_convs": members, "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "key": keys,
            "parent": parents, "ends": digest,
        }
        for i in np.flatnonzero(part):
            ended = conv[begins[i] : begins[i] + stop[i]]
            for a in range(0, len(ended), CHUNK):
                yield _one(kind=_ENDS, shard=shard, at=a, key=keys[i], ends=_decimals(ended[a : a + CHUNK]))
        above[active] = np.repeat(smallest, members)
        above_part[active] = np.repeat(np.where(has_first, 1, np.where(has_last, 2, 0)), members)
        active = active[lens > depth]
        depth += 1
    for kind, row in ((_FIRST, 0), (_LAST, rows.n - 1)):
        yield _one(kind=kind, shard=shard, key=rows.path(row), ends=rows.sizes(row).astype("<i8").tobytes())


def _one(**held) -> dict:
    return {name: [held.get(name)] for name in _NAMES}


def _batch(held: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held[f.name], f.type) for f in schema], schema=schema)


_ARROW = pa.schema(
    [
        (name, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[kind])
        for name, kind in (part.split() for part in _NODES.split(","))
    ]
)


def _sharded(held: DataFrame, shards: int) -> DataFrame:
    """Whole nodes, parts, edges and ends of all shards."""
    path = F.unhex(F.array_join(F.transform("turns", lambda x: x["id"]), ""))
    flat = held.select("conv_id", path.alias("path"), F.transform("turns", lambda x: x["bytes"]).alias("sizes"))
    ranged = flat.repartitionByRange(shards, "path", "conv_id").withColumn("shard", F.spark_partition_id())

    def run(batches):
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        conv, shard = table["conv_id"].to_numpy(), table["shard"][0].as_py()
        sizes = table["sizes"].combine_chunks()
        lens = sizes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        ids = np.frombuffer(b"".join(table["path"].to_pylist()), np.uint8).reshape(-1, _ID)
        rows = _Rows(conv, lens, np.ascontiguousarray(ids), sizes.flatten().to_numpy(zero_copy_only=False))
        for nodes in _shard_nodes(rows, shard):
            yield _batch(nodes, _ARROW)

    return ranged.mapInArrow(tidy(run), _NODES)


def _corrections(edges: DataFrame) -> DataFrame:
    """Parts that hang on what the last row of a shard and the first row of the next have in common.

    Two rows a shard, so one window orders them all.
    """
    order = Window.orderBy("shard", "kind")
    beside = edges.filter(F.col("kind").isin(_FIRST, _LAST)).select(
        "kind", "shard", F.col("key").alias("path"), "ends",
        F.lag("key").over(order).alias("before"), F.lead("key").over(order).alias("after"),
    )

    def shared(a: bytes | None, b: bytes) -> int:
        """Turns in common; -1 if there is no neighbour."""
        if a is None:
            return -1
        n = min(len(a), len(b)) // _ID * _ID
        x, y = (np.frombuffer(z[:n], np.uint8).reshape(-1, _ID) for z in (a, b))
        apart = np.flatnonzero((x != y).any(axis=1))
        return int(apart[0]) if len(apart) else n // _ID

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                path, n = row["path"], len(row["path"]) // _ID
                keys = _digests(path)
                out = {name: [] for name in _NAMES}
                if row["kind"] == _FIRST:
                    before = shared(row["before"], path)
                    total = np.concatenate([[0], np.cumsum(np.frombuffer(row["ends"], "<i8"))])
                for depth in range(n + 1):
                    children = leaves = saved = 0
                    if row["kind"] == _FIRST:
                        children = int(n > depth >= before)
                        saved = int(total[before] - total[max(depth - 1, 0)]) if before >= depth else 0
                    else:
                        leaves = int(shared(row["after"], path) < n) if depth == 0 else out["n_leaves"][0]
                    add = dict(kind=_PART, depth=depth, n_convs=0, n_children=children, n_leaves=leaves,
                               saved_tokens=saved, key=keys[depth], parent=keys[depth - 1] if depth else None)
                    for name in _NAMES:
                        out[name].append(add.get(name))
                yield _batch(out, _ARROW)

    return beside.mapInArrow(run, _NODES)


def _joined_ends(parts: DataFrame) -> DataFrame:
    """(key, sha) of the ids that end at each boundary node, hashed as a stream in the order of shards and places."""
    chunks = parts.filter(F.col("kind") == _ENDS).select("key", "shard", "at", "ends")
    dealt = chunks.repartition("key").sortWithinPartitions("key", "shard", "at")

    def run(batches):
        key, digest = None, None
        for batch in batches:
            for now, held in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if now != key:
                    if digest:
                        yield done(key, digest)
                    key, digest = now, hashlib.sha256(held)
                else:
                    digest.update(b"," + held)
        if digest:
            yield done(key, digest)

    def done(key, digest):
        return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.digest()])], names=["key", "sha"])

    return dealt.mapInArrow(run, "key binary, sha binary")


def nodes(held: DataFrame, *, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The nodes of the trie over conversations (conv_id, turns of id and bytes), the textless root included.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256). No conversations, no nodes.
    """
    spark = held.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), held.count() // shard_rows + 1)
    made = stage(_sharded(held, shards), "trie")
    parts = made.filter(F.col("kind") == _PART).unionByName(_corrections(made))
    merged = parts.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent").alias("parent"),
        *[F.sum(name).alias(name) for name in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    empty = F.lit(hashlib.sha256(b"").digest())
    boundary = stage(
        merged.join(_joined_ends(made), "key", "left").withColumn("ends", F.coalesce("sha", empty)), "trie-boundary"
    )
    measures = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    every = made.filter(F.col("kind") == _WHOLE).select(*measures, "parent_conv_id", "parent").unionByName(
        boundary.select(*measures, F.lit(None).cast("long").alias("parent_conv_id"), "parent")
    )
    names = boundary.select(F.col("key").alias("parent"), F.col("conv_id").alias("named"))
    few = names.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    found = every.join(F.broadcast(names) if few else names, "parent", "left")
    return found.select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "named").alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", "saved_tokens", F.lower(F.hex("ends")).alias("ends_sha256"),
    )


def trie(turns: DataFrame, *, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The prefix trie of a table of turns as it stands (see ``nodes``)."""
    return nodes(stage(ordered_turns(turns), "turns"), shard_rows=shard_rows)


def branched_trie(turns: DataFrame, *, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The prefix trie of the conversations rebuilt on the first of their family (see ``branched``)."""
    held = stage(ordered_turns(turns), "turns")
    return nodes(stage(branched(held), "branched"), shard_rows=shard_rows)
