"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; the unlabelled set is all labelled documents with the labels
hidden, so its share of toxic ones is the class prior, which is counted over all training rows. The classifiers are
linear in the presence of words and of word beginnings and minimise, in numpy,

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))

with the logistic loss. A score is the mean probability of the classifiers.

Training reads all labelled rows that are not held out. They are dealt by a hash of the id into shares of about
``UNLABELLED`` rows, each joined by one of the groups of at least ``POSITIVES`` positives (all of them where they are
fewer); every share is fitted in a task, and the weights are averaged over the shares by their rows. A null text counts
as an empty one. Without a confirmed toxic row every score is 0.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.staging import stage
from tillroll.llm.text import FOLDED_VALUES, NOT_ALNUM, held_out, rolling, slices, span_hash, tidy, utf8, wider, words

#: Labels that are broadcast to the texts at most; with more of them texts and labels are shuffled to meet.
BROADCAST_LABELS = 8_000_000
#: Rows of a group of positives at least, and of a share of the unlabelled about.
POSITIVES, UNLABELLED = 3_000, 5_000
#: Bytes of a word's beginning that are features beside the whole word.
PREFIXES = (4, 5, 6, 7)
#: Features that the classifiers may use: how far above chance they must be among positives, and in how many of them.
FEATURES, LEAST_Z, LEAST_POSITIVES, LEAST_SHARE = 800, 4.0, 4, 0.01
CLASSIFIERS, STEPS, RATE, DECAY = 3, 300, 0.05, 1e-4
_PLACE_BITS = 20


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each word and word beginning of the texts, in the order of the text numbers."""
    data, bounds = utf8(column)
    starts, ends, row = words(data, bounds, NOT_ALNUM)
    sums = rolling(data, FOLDED_VALUES)
    found, owners = [span_hash(sums, starts, ends)], [row]
    for i, size in enumerate(PREFIXES):
        longer = ends - starts > size
        found.append(span_hash(sums, starts[longer], starts[longer] + size) ^ np.uint64(i + 1))
        owners.append(row[longer])
    return np.concatenate(found), np.concatenate(owners)


def distinct(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[fresh], row[fresh]


@dataclasses.dataclass
class Model:
    """``keys``: hashes of the features; ``weights``: a row per classifier; ``bias``: one per classifier."""

    keys: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def __post_init__(self):
        order = np.argsort(self.keys)
        self.keys, self.weights = self.keys[order], self.weights[:, order]

    def hits(self, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Feature number and text number of each distinct known feature of a text."""
        if not len(self.keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        place = np.zeros(1 << _PLACE_BITS, bool)
        place[self.keys >> np.uint64(64 - _PLACE_BITS)] = True
        near = np.flatnonzero(place[h >> np.uint64(64 - _PLACE_BITS)])
        at = np.minimum(np.searchsorted(self.keys, h[near]), len(self.keys) - 1)
        same = self.keys[at] == h[near]
        pair = np.unique(row[near[same]] * len(self.keys) + at[same])
        return pair % len(self.keys), pair // len(self.keys)

    def score(self, column: pa.Array) -> np.ndarray:
        which, row = self.hits(*features(column))
        n = len(column)
        total = np.zeros(n)
        for w, b in zip(self.weights, self.bias, strict=True):
            total += 1 / (1 + np.exp(-np.clip(b + np.bincount(row, w[which], n), -50, 50)))
        return total / max(1, len(self.bias))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def risk_parts(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float]:
    """The risk of positives, and the estimated risk of negatives, of weights with the bias at their end."""
    zp, zu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
    loss = lambda z: np.logaddexp(0, -z).mean()
    return float(prior * loss(zp)), float(loss(-zu) - prior * loss(-zp))


def risk_gradient(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """The gradient of the sum of both parts; where the second is negative, which no risk is, against its own alone."""
    zp, zu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
    loss = lambda z: np.logaddexp(0, -z)
    negative = loss(-zu).mean() - prior * loss(-zp).mean()
    gp_neg, gu_neg = _sigmoid(zp) / len(p), _sigmoid(zu) / len(u)
    if negative >= 0:
        gp, gu = prior * (_sigmoid(zp) - 1) / len(p) - prior * gp_neg, gu_neg
    else:
        gp, gu = prior * gp_neg, -gu_neg
    return np.append(p.T @ gp + u.T @ gu, gp.sum() + gu.sum())


def fit_nnpu(x_pos: np.ndarray, x_unl: np.ndarray, prior: float, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias of one linear classifier, trained on a bootstrap draw with Adam."""
    rng = np.random.default_rng(seed)
    p = x_pos[rng.integers(0, len(x_pos), len(x_pos))]
    u = x_unl[rng.integers(0, len(x_unl), len(x_unl))]
    w = np.zeros(p.shape[1] + 1, np.float32)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        grad = risk_gradient(w, p, u, np.float32(prior))
        grad[:-1] += DECAY * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def _dealt(parts: int):
    """Which of ``parts`` a row belongs to, by its id."""
    return F.pmod(F.xxhash64(F.col("doc_id"), F.lit("toxicity")), F.lit(parts)).cast("int")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from the labels of the rows that are not held out."""
    known = labels.filter(~held_out() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = known.agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("p")).first()
    if not counts.p:
        return Model(np.empty(0, np.uint64), np.empty((0, 0)), np.empty(0))
    prior = min(max(counts.p / counts.n, 1e-4), 0.9)
    groups = max(1, counts.p // POSITIVES)
    shares = max(groups, -(-counts.n // UNLABELLED))
    chosen = known.select("doc_id", (F.col("toxic") == 1).alias("is_pos"))
    if counts.n <= BROADCAST_LABELS:  # texts stay where they are
        chosen = F.broadcast(chosen)
    sample = stage(docs.select("doc_id", "text").join(chosen, "doc_id"), "toxicity-labelled")

    def count(batches):
        for batch in slices(batches, 1):
            h, row = distinct(*features(batch.column(1)))
            pos = batch.column(2).to_numpy(zero_copy_only=False)[row]
            key, which = np.unique(h, return_inverse=True)
            n_pos, n_unl = np.bincount(which, pos, len(key)), np.bincount(which, minlength=len(key))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(n_pos.astype(np.int64)), pa.array(n_unl.astype(np.int64))],
                names=["key", "pos", "unl"],
            )

    n = sample.agg(F.count_if("is_pos").alias("pos"), F.count("*").alias("unl")).first()
    if not n.pos or not n.unl:
        return Model(np.empty(0, np.uint64), np.empty((0, 0)), np.empty(0))
    table = sample.mapInArrow(tidy(count), "key long, pos long, unl long").groupBy("key").agg(
        F.sum("pos").alias("pos"), F.sum("unl").alias("unl")
    )
    rate, base = F.col("pos") / n.pos, (F.col("unl") + 0.5) / n.unl
    z = (rate - base) / F.sqrt(base * (1 / n.pos + 1 / n.unl))
    best = (
        table.filter(F.col("pos") >= max(LEAST_POSITIVES, int(LEAST_SHARE * n.pos)))
        .withColumn("z", z)
        .filter(F.col("z") >= LEAST_Z)
        .orderBy(F.desc("z"), "key")
        .limit(FEATURES)
    )
    keys = np.array([r.key for r in best.select("key").collect()], np.int64).view(np.uint64)
    shape = Model(keys, np.zeros((1, len(keys))), np.zeros(1))

    def vectors(batches):
        for batch in slices(batches, 1):
            which, row = shape.hits(*features(batch.column(1)))
            held = [[] for _ in range(batch.num_rows)]
            for i, r in zip(which.tolist(), row.tolist(), strict=True):
                held[r].append(i)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(held, pa.list_(pa.int32()))],
                names=["doc_id", "is_pos", "hits"],
            )

    def train(batches):
        found: dict[int, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                found.setdefault(r["share"], []).append((r["as_pos"], r["doc_id"], r["hits"]))
        out = {"share": [], "rows": [], "weights": []}
        for share, rows in found.items():
            rows.sort()  # rows of one id have an order by their hits
            x = np.zeros((len(rows), len(keys)), np.float32)
            for i, (_, _, hits) in enumerate(rows):
                x[i, hits] = 1
            pos = np.array([as_pos for as_pos, _, _ in rows])
            if pos.any() and not pos.all():
                trained = [np.append(*fit_nnpu(x[pos], x[~pos], prior, seed)) for seed in range(CLASSIFIERS)]
                out["share"].append(share)
                out["rows"].append(int((~pos).sum()))
                out["weights"].append(np.array(trained, np.float64).tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(out["share"], pa.int32()), pa.array(out["rows"], pa.int64()), pa.array(out["weights"], pa.binary())],
            names=list(out),
        )

    rows = sample.mapInArrow(tidy(vectors), "doc_id long, is_pos boolean, hits array<int>")
    rows = stage(rows, "toxicity-hits")
    hidden = rows.select("doc_id", "hits", F.lit(False).alias("as_pos"), _dealt(shares).alias("share"))
    joined = F.explode(F.sequence(_dealt(groups), F.lit(shares - 1), F.lit(groups)))
    shown = rows.filter("is_pos").select("doc_id", "hits", F.lit(True).alias("as_pos"), joined.alias("share"))
    dealt = hidden.union(shown).repartition(shares, "share")
    made = sorted(dealt.mapInArrow(tidy(train), "share int, rows long, weights binary").collect(), key=lambda r: r.share)
    total = sum(r.rows for r in made)
    if not total:
        return Model(np.empty(0, np.uint64), np.empty((0, 0)), np.empty(0))
    mean = sum(np.frombuffer(bytes(r.weights)).reshape(CLASSIFIERS, -1) * (r.rows / total) for r in made)
    return Model(shape.keys, mean[:, :-1], mean[:, -1])


def score(docs: DataFrame, model: Model, column: str = "text", name: str = "toxicity") -> DataFrame:
    """Adds the score (0 to 1) of every whole text."""
    schema, place = wider(docs, **{name: "double"}), docs.columns.index(column)

    def run(batches):
        for batch in slices(batches, place):
            scores = pa.array(model.score(batch.column(place)))
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, name])

    return docs.mapInArrow(tidy(run), schema)
