"""Approximate nearest neighbours on shifted space-filling curves, then an exact check.

1. Equal vectors are one point with its smallest ids; only as many ids stay as an answer can hold.
2. Points are projected to ``DIMENSIONS`` by a random orthogonal map, one for each of ``CURVES`` curves, shifted and put
   on a grid of ``2**BITS`` steps a side. The cells are ordered by a Hilbert curve and Spark range-partitions the points
   by curve and key.
3. A query's windows are the ``WINDOW`` points before and after its place on every curve (within its partition). The
   windows of all curves merge and are reranked by exact distances; the last one kept bounds how far the query looks.
4. Check: the queries, in blocks of at most ``QUERIES``, meet all points (a stated query set in blocks, never all pairs)
   and only points within a query's bound are kept. Points are read in the order of the first curve, in compact groups;
   a group is passed over for the queries whose bound ends before it.

The curves alone find neighbours that are close in most directions; vectors without such structure need the check,
after which the answer is exact. Distances are Euclidean, in double precision, on the given vectors.

Vectors that are null, empty, zero, of another width than most, or with null or non-finite components take no part.
Rows that repeat an id and vector count once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.staging import stage
from tillroll.llm.text import tidy

DIMENSIONS, BITS, CURVES, WINDOW = 6, 10, 4, 128
#: Points compared at once, and queries that the driver hands to all tasks (20,000 of 64 components are 10 MB).
POINTS, QUERIES = 1_024, 20_000

_U = np.uint64


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of grid coordinates (Skilling's transposition, for all rows at once)."""
    x = cells.astype(_U).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = _U(q - 1)
        for i in range(n):
            high = (x[i] & _U(q)) != 0
            swap = np.where(high, _U(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & _U(q)) != 0, _U(q - 1), _U(0))
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << _U(1)) | ((x[i] >> _U(bit)) & _U(1))
    return key.astype(np.int64)


def _curve(width: int, curve: int) -> tuple[np.ndarray, np.ndarray]:
    """The projection and the shift of a curve."""
    rng = np.random.default_rng([width, curve])
    turn, _ = np.linalg.qr(rng.normal(size=(width, width)))
    return turn[:, : min(DIMENSIONS, width)], rng.random(min(DIMENSIONS, width))


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _clean(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the vectors that take part."""
    held = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter(
        "vec_id is not null and embedding is not null and size(embedding) > 0"
    )
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = held.filter(finite & F.exists("embedding", lambda x: x != 0))
    width = held.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").first()
    return held.filter(F.size("embedding") == (width.width if width else 0)).distinct()


def _points(held: DataFrame, k: int) -> DataFrame:
    """Different vectors with their k + 1 smallest ids; copies are thinned in parts before they meet."""
    split = held.withColumn("key", F.xxhash64("embedding")).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    few = split.withColumn("nth", F.expr("row_number() over (partition by key, embedding, part order by vec_id)"))
    few = few.filter(F.col("nth") <= k + 1).drop("nth")
    few = few.withColumn("nth", F.expr("row_number() over (partition by key, embedding order by vec_id)"))
    ids = few.filter(F.col("nth") <= k + 1).groupBy("key", "embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return ids.select("key", F.element_at("ids", 1).alias("point"), "ids", "embedding")


def _keyed(points: DataFrame, width: int, scale: float) -> DataFrame:
    """curve and key of every point on every curve, before its other columns (point, ids, embedding, asks)."""

    def run(batches):
        for batch in batches:
            x = _rows(batch.column(2), width) / scale
            for curve in range(CURVES):
                project, shift = _curve(width, curve)
                cells = ((np.clip(x @ project, -1, 1) + 1) / 2 + shift) / 2 * ((1 << BITS) - 1)
                key = pa.array(hilbert_keys(cells.astype(np.int64), BITS))
                names = ["curve", "key", *batch.schema.names]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), curve, np.int32)), key, *batch.columns], names=names)

    return points.mapInArrow(tidy(run), "curve int, key long, point long, ids array<long>, embedding array<double>, asks boolean")


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, summed from the first component to the last."""
    return np.sqrt(np.cumsum(np.square(x - y), axis=-1)[..., -1])


def _answers(queries, best):
    """A batch (point, vec_id, score) of what each query keeps."""
    size = [len(d) for _, d in best]
    columns = (np.repeat(np.asarray(queries, np.int64), size), *(np.concatenate([b[i] for b in best]) for i in (0, 1)))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["point", "vec_id", "score"])


def _spread(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the points, and the number of the point of each."""
    size = ids.value_lengths().to_numpy(zero_copy_only=False)
    return ids.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(size)), size)


def _windows(ordered: DataFrame, k: int, width: int) -> DataFrame:
    """Candidates (point, vec_id, score) from the windows around each asking point, k + 1 per curve and partition."""

    def search(curve: pa.Table):
        x = _rows(curve.column("embedding").combine_chunks(), width)
        ids, owner = _spread(curve.column("ids").combine_chunks())
        points = curve.column("point").to_numpy()
        queries, best = [], []
        for i in np.flatnonzero(curve.column("asks").to_numpy()):
            low, high = max(0, i - WINDOW), min(len(x), i + WINDOW + 1)
            a, b = np.searchsorted(owner, (low, high))
            d = distances(x[low:high], x[i])[owner[a:b] - low]
            order = np.lexsort((ids[a:b], d))[: k + 1]
            queries.append(points[i])
            best.append((ids[a:b][order], d[order]))
        return _answers(queries, best) if queries else None

    def run(batches):
        held = [[] for _ in range(CURVES)]
        for batch in batches:  # a partition's rows come by curve and key
            curve = batch.column(0).to_numpy()
            for c in np.unique(curve):
                a, b = np.searchsorted(curve, (c, c + 1))
                held[c].append(batch.slice(a, b - a))
        for parts in held:
            if parts and (found := search(pa.Table.from_batches(parts))):
                yield found

    return ordered.mapInArrow(tidy(run), "point long, vec_id long, score double")


def _nearest(found: DataFrame, most: int) -> DataFrame:
    rank = F.expr("row_number() over (partition by point order by score, vec_id)")
    return found.distinct().withColumn("rank", rank).filter(F.col("rank") <= most)


def _checked(points: DataFrame, queries: list, k: int, width: int) -> DataFrame:
    """All points within the bound of each query (point, embedding, bound) of one block."""
    name = np.array([q[0] for q in queries], np.int64)
    y, bound = np.array([q[1] for q in queries], np.float64), np.array([q[2] for q in queries], np.float64)
    square = (y * y).sum(axis=1)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, POINTS):
                part = batch.slice(at, POINTS)
                x = _rows(part.column(1), width)
                ids, owner = _spread(part.column(0))
                begin = np.searchsorted(owner, np.arange(len(x) + 1))
                centre = x.mean(axis=0)
                radius = np.sqrt(((x - centre) ** 2).sum(axis=1).max())
                reach = np.sqrt(((y - centre) ** 2).sum(axis=1)) - radius
                near = np.flatnonzero(reach <= bound * (1 + 1e-9) + 1e-12)
                for low in range(0, len(near), 512):
                    some = near[low : low + 512]
                    d2 = square[some, None] + (x * x).sum(axis=1) - 2 * (y[some] @ x.T)
                    slack = 1e-9 * (1 + square[some]) + bound[some] ** 2
                    q, p = np.nonzero(d2 <= np.where(np.isinf(bound[some]), np.inf, slack)[:, None])
                    d = distances(y[some[q]], x[p])
                    keep = d <= bound[some[q]]
                    q, p, d = q[keep], p[keep], d[keep]
                    size = begin[p + 1] - begin[p]
                    take = np.repeat(begin[p] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                    columns = (np.repeat(name[some[q]], size), ids[take], np.repeat(d, size))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["point", "vec_id", "score"])

    return points.select("ids", "embedding").mapInArrow(tidy(run), "point long, vec_id long, score double")


def search(vectors: DataFrame, k: int = 10, every: int = 100, check: bool = True) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k nearest other vectors of each query, nearest first.

    Queries are the vectors whose id is divisible by ``every``. Ties go to the smaller id. Without ``check`` the answer
    is that of the curves alone.
    """
    spark = vectors.sparkSession
    held = stage(_clean(vectors), "vectors")
    shape = held.agg(
        F.max(F.size("embedding")).alias("width"),
        F.avg(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)).alias("square"),
    ).first()
    width = shape.width or 1
    scale = 4 * ((shape.square or 1.0) / width) ** 0.5
    asked = held.filter(F.pmod("vec_id", F.lit(every)) == 0)
    asked = asked.select(F.col("vec_id").alias("query_id"), F.xxhash64("embedding").alias("key"), "embedding")
    points = stage(_points(held, k), "vector-points")
    query = stage(asked.join(points.select("key", "embedding", "point"), ["key", "embedding"]).select("query_id", "point"), "queries")
    asking = query.select("point").distinct().withColumn("asks", F.lit(True))
    points = points.join(asking, "point", "left").select("point", "ids", "embedding", F.coalesce("asks", F.lit(False)).alias("asks"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = stage(
        _keyed(points, width, scale).repartitionByRange(n, "curve", "key", "point").sortWithinPartitions("curve", "key", "point"),
        "curves",
    )
    found = stage(_nearest(_windows(ordered, k, width), k + 1), "window-answers")
    if check:
        bound = found.filter(F.col("rank") == k + 1).select("point", F.col("score").alias("bound"))
        first = ordered.filter("curve = 0")
        todo = first.filter("asks").select("point", "embedding").join(bound, "point", "left")
        todo = stage(todo.withColumn("bound", F.coalesce("bound", F.lit(float("inf")))), "query-bounds")
        blocks = -(-todo.count() // QUERIES)
        for block in range(blocks):
            own = todo.filter(F.pmod(F.xxhash64("point"), F.lit(blocks)) == block)
            rows = [(r.point, r.embedding, r.bound) for r in own.collect()]
            if rows:
                more = stage(_checked(first, rows, k, width), "checked")
                found = found.drop("rank").unionByName(more)
                found = stage(_nearest(found, k + 1), "answers") if block % 8 == 7 else _nearest(found, k + 1)
    others = query.join(found.drop("rank"), "point").filter("vec_id <> query_id")
    rank = F.expr("row_number() over (partition by query_id order by score, vec_id)").cast("int")
    return others.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
