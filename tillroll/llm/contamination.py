"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into passages of ``WINDOW`` words that overlap by half; benchmark items into pieces of at most ``PIECE``
words. Terms are the words of the benchmark, weighted by TF-IDF with passage counts over all documents; other words only
lengthen a passage. A randomised SVD gives the latent space. Its rows are all benchmark pieces and all passages of all
documents. Tasks sum the products of terms that share a row, as many rows of that matrix at a time as ``CELLS`` allows;
Spark adds them up and multiplies them, only matrices of (terms x rank) reach the driver. Every passage of every
document is then searched. A space serves at most ``SPACE`` pieces and is widened by what it lacks of a piece until it
holds ``CAPTURED`` of each. A passage and a piece whose latent cosine reaches ``COSINE`` (a passage counts no longer than
the piece, so that a short piece is not lost among the passage's other words) are compared by their longest
common subsequence of words, over the passage and half a window on both sides. It is a leak when the subsequence
covers ``VERBATIM`` of the piece, or ``PARAPHRASE`` of it and the item's answer (its last sentence, at least half of
whose words must stand there) in a passage whose cosine at full length reaches ``COSINE``. Pieces under ``SHORT`` words
must be covered whole.

The benchmark is taken in blocks of about ``BLOCK`` items, whose pieces are dealt over spaces, so what a task holds is
bounded for any benchmark. Each space is fitted and searched in passes over the documents of its own.
Null texts are empty and match nothing.
"""

from __future__ import annotations

import dataclasses
import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.staging import stage
from tillroll.llm.text import FOLDED_VALUES, NOT_ALNUM, rolling, slices, span_hash, tidy, utf8, words

HALF = 32
WINDOW, PIECE, SHORT = 2 * HALF, 64, 6
RANK, OVERSAMPLE, BLOCK = 192, 8, 10_000
COSINE, VERBATIM, PARAPHRASE = 0.25, 0.8, 0.6
#: Pieces that share a space, and the share of each piece's squared length that the space holds at least.
SPACE, CAPTURED = 256, 0.99
#: Rows of term matrices that tasks sum together.
TERM_ROWS = 512
#: Cells of the matrix of terms by terms that a task holds at a time, and that are sent as one.
CELLS, CELLS_SENT = 1 << 24, 1 << 18
#: Terms whose products are summed by a matrix product; those of the others are summed one by one.
FREQUENT = 256
#: Passages that are compared with the pieces at a time.
PASSAGES = 4096
#: Terms whose counts are summed by a matrix product.
COMMON = 256


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word (letters and digits, A-Z folded), in order."""
    data, bounds = utf8(column)
    starts, ends, row = words(data, bounds, NOT_ALNUM)
    return span_hash(rolling(data, FOLDED_VALUES), starts, ends), row


@dataclasses.dataclass
class Pieces:
    """Pieces of a block of items: ``terms`` sorted word hashes, and per piece the item, its words and its answer."""

    terms: np.ndarray
    item: list
    words: list[np.ndarray]
    answer: list[np.ndarray]

    @classmethod
    def of(cls, items: list[tuple[int, str]]) -> Pieces:
        item, held, answer = [], [], []
        for item_id, text in items:
            h, _ = hashed_words(pa.array([text]))
            sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n", text or "") if s.strip()]
            last = hashed_words(pa.array(sentences[-1:], pa.string()))[0]
            parts = max(1, -(-len(h) // PIECE))
            for i, part in enumerate(np.array_split(h, parts)):
                if len(part):
                    item.append(item_id)
                    held.append(part)
                    answer.append(last if i == parts - 1 else last[:0])
        terms = np.unique(np.concatenate([np.empty(0, np.uint64), *held]))
        return cls(terms, item, [cls._ids(terms, h) for h in held], [cls._ids(terms, h) for h in answer])

    def spaces(self) -> list[Pieces]:
        """The pieces dealt over parts of at most ``SPACE`` pieces, each with the terms of its own pieces."""
        if len(self.words) <= SPACE:
            return [self] if self.words else []
        parts = []
        for at in np.array_split(np.arange(len(self.words)), -(-len(self.words) // SPACE)):
            hashes = [self.terms[self.words[i]] for i in at]
            # an answer may begin in a piece of another part
            answers = [self.terms[self.answer[i]] for i in at]
            terms = np.unique(np.concatenate([*hashes, *answers]))
            ids = ([self._ids(terms, h) for h in held] for held in (hashes, answers))
            parts.append(Pieces(terms, [self.item[i] for i in at], *ids))
        return parts

    @staticmethod
    def _ids(terms: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Number of each word among the terms, -1 for other words."""
        if not len(terms):
            return np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
        return np.where(terms[at] == h, at, -1)

    def ids(self, h: np.ndarray) -> np.ndarray:
        near = np.zeros(1 << 16, bool)
        near[self.terms >> np.uint64(48)] = True
        found = np.full(len(h), -1, np.int64)
        maybe = np.flatnonzero(near[h >> np.uint64(48)])
        found[maybe] = self._ids(self.terms, h[maybe])
        return found


def passages(ids: np.ndarray, row: np.ndarray, texts: int):
    """Of each word the half window it lies in; of each half window its text and first word.

    Half windows are numbered through all texts; a passage is a half window and the next one of its text.
    """
    count = np.bincount(row, minlength=texts)
    first = np.cumsum(count) - count
    halves = -(-count // HALF)
    begin = np.cumsum(halves) - halves
    place = np.arange(len(ids)) - first[row]
    half = begin[row] + place // HALF
    owner = np.repeat(np.arange(texts), halves)
    start = (np.arange(len(owner)) - begin[owner]) * HALF + first[owner]
    return half, owner, start


def _passage_terms(ids: np.ndarray, half: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (passage, term) of the passages that begin at each half window."""
    known = np.flatnonzero(ids >= 0)
    at, term = half[known], ids[known]
    later = at[(at > 0)] - 1
    same = owner[later] == owner[later + 1] if len(later) else np.empty(0, bool)
    width = int(ids.max(initial=0)) + 1
    pair = np.unique(np.concatenate([at * width + term, (later * width + term[at > 0])[same]]))
    return pair // width, pair % width


def _held_terms(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """A row for each slice of texts: the distinct terms of its passages one after the other, and how many each has."""
    kind = _term_kind(pieces)

    def run(batches):
        for batch in slices(batches):
            h, row = hashed_words(batch.column(0))
            ids = pieces.ids(h)
            half, owner, _ = passages(ids, row, batch.num_rows)
            passage, term = _passage_terms(ids, half, owner)
            size = np.bincount(passage, minlength=len(owner)).astype(np.uint8)  # at most ``WINDOW``
            held = [pa.array([x.tobytes()], pa.binary()) for x in (term.astype(kind), size)]
            yield pa.RecordBatch.from_arrays(held, names=["terms", "sizes"])

    return docs.select("text").mapInArrow(tidy(run), "terms binary, sizes binary")


def _term_kind(pieces: Pieces) -> type:
    return np.uint16 if len(pieces.terms) <= 1 << 16 else np.uint32


def document_frequency(docs: DataFrame, pieces: Pieces) -> tuple[np.ndarray, int]:
    """In how many passages of all documents each term occurs, and how many passages there are."""
    return _frequency(_held_terms(docs, pieces), pieces)


def _frequency(held: DataFrame, pieces: Pieces) -> tuple[np.ndarray, int]:
    kind = _term_kind(pieces)

    def run(batches):
        total = np.zeros(len(pieces.terms) + 1, np.int64)
        for batch in batches:
            for terms, sizes in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                total += np.bincount(np.frombuffer(terms, kind), minlength=len(total))
                total[-1] += len(sizes)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "n"])

    rows = held.mapInArrow(tidy(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(len(pieces.terms) + 1, np.int64)
    for r in rows:
        total[r.term] = r.n
    return total[:-1], int(total[-1])


@dataclasses.dataclass
class Latent:
    """``space``: a row per term, already weighted by its idf; ``piece``: unit vectors of the benchmark pieces, as far as
    the space holds them; ``length``: their lengths before."""

    idf: np.ndarray
    other: float
    space: np.ndarray
    piece: np.ndarray
    length: np.ndarray


def widened(right: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """The orthonormal columns ``right`` and as many more as it takes to hold ``CAPTURED`` of each unit row."""
    rest = pieces - (pieces @ right) @ right.T
    lacking = (rest**2).sum(axis=1) > 1 - CAPTURED
    if not lacking.any():
        return right
    _, size, more = np.linalg.svd(rest[lacking], full_matrices=False)
    more = more[size > 1e-6].T
    more -= right @ (right.T @ more)
    return np.hstack([right, np.linalg.qr(more)[0]])


def _summed(df: DataFrame, pieces: Pieces, product) -> np.ndarray:
    """The sum over all rows of ``df`` of ``product`` (a matrix with a row per term), block by block of terms."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        total = None
        for batch in batches:
            part = product(batch)
            total = part if total is None else total + part
        if total is not None:
            blocks = range(0, len(total), TERM_ROWS)
            held = [total[i : i + TERM_ROWS].tobytes() for i in blocks]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(blocks), pa.int64()), pa.array(held, pa.binary())], names=["block", "part"]
            )

    def add(batches):
        total = {}
        for batch in batches:
            for block, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                value = np.frombuffer(part, np.float64)
                total[block] = value if block not in total else total[block] + value
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())],
            names=["block", "part"],
        )

    shape = "block long, part binary"
    rows = df.mapInArrow(tidy(run), shape).repartition(n, "block").mapInArrow(tidy(add), shape).collect()
    whole = b"".join(bytes(r.part) for r in sorted(rows, key=lambda r: r.block))
    return np.frombuffer(whole, np.float64).reshape(len(pieces.terms), -1)


def _add_products(total: np.ndarray, low: int, frequent: int, term: np.ndarray, size: np.ndarray, value: np.ndarray) -> None:
    """Adds to ``total``, rows from ``low`` on of a matrix of terms by terms, the products of the values of all terms that
    share one of the rows of ``size`` terms. Each pair stands once, in the row of the lesser term, but for those of two
    of the ``frequent`` first terms, which stand in both."""
    row = np.repeat(np.arange(len(size)), size)
    often, rare = np.flatnonzero(term < frequent), np.flatnonzero(term >= frequent)
    if low == 0:
        x = np.zeros((len(size), frequent), np.float32)
        x[row[often], term[often]] = value[often]
        total[:frequent, :frequent] += x.T @ x
        # each of the others with the frequent ones of its row
        count = np.bincount(row[often], minlength=len(size))
        first, second = _paired((np.cumsum(count) - count)[row[rare]], count[row[rare]])
        _add_pairs(total, term[often[second]], term[rare[first]], value[often[second]] * value[rare[first]])
    # and with itself and the others that follow
    end = np.cumsum(np.bincount(row[rare], minlength=len(size)))[row[rare]]
    first, second = _paired(np.arange(len(rare)), end - np.arange(len(rare)))
    first, second = rare[first], rare[second]
    least, most = np.minimum(term[first], term[second]), np.maximum(term[first], term[second])
    if low > frequent or low + len(total) < total.shape[1]:
        mine = np.flatnonzero((least >= low) & (least < low + len(total)))
        first, second, least, most = first[mine], second[mine], least[mine], most[mine]
    _add_pairs(total, least - low, most, value[first] * value[second])


def _paired(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every number with each of its ``count`` partners, which are numbered from ``begin`` on."""
    first = np.repeat(np.arange(len(count)), count)
    return first, np.arange(len(first)) + np.repeat(begin - np.cumsum(count) + count, count)


def _add_pairs(total: np.ndarray, row: np.ndarray, column: np.ndarray, value: np.ndarray) -> None:
    np.add.at(total.reshape(-1), row * total.shape[1] + column, value)


def _products(held: DataFrame, pieces: Pieces, idf: np.ndarray, order: np.ndarray) -> DataFrame:
    """The sum of x' x over all rows x: unit vectors of ``held`` terms, times their weight.

    Terms are numbered in ``order``. A row (block, part) has the rows of the matrix from ``block`` on, without what is
    below the diagonal, which mirrors what is above it.
    """
    n, kind, terms = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), _term_kind(pieces), len(order)
    place = np.empty(terms, np.int64)
    place[order] = np.arange(terms)
    idf = idf[order]
    frequent = min(FREQUENT, terms)
    rows, sent = max(frequent, CELLS // terms), max(1, CELLS_SENT // terms)
    shape = "block long, part binary"

    def band(low: int, high: int):
        def run(batches):
            total, some = np.zeros((high - low, terms), np.float32), False
            for batch in batches:
                columns = (batch.column(i).to_pylist() for i in range(3))
                for held_terms, sizes, weight in zip(*columns, strict=True):
                    term, size = place[np.frombuffer(held_terms, kind)], np.frombuffer(sizes, np.uint8).astype(np.int64)
                    ends = np.concatenate([[0], np.cumsum(size)])
                    some = True
                    for at in range(0, len(size), PASSAGES):
                        mine, count = term[ends[at] : ends[min(at + PASSAGES, len(size))]], size[at : at + PASSAGES]
                        row = np.repeat(np.arange(len(count)), count)
                        norm = np.sqrt(np.bincount(row, idf[mine] ** 2, len(count)))
                        value = (weight * idf[mine] / np.maximum(norm, 1e-9)[row]).astype(np.float32)
                        _add_products(total, low, frequent, mine, count, value)
            if some and low == 0:
                total[:frequent, :frequent] = np.triu(total[:frequent, :frequent])
            for at in range(0, high - low if some else 0, sent):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([low + at], pa.int64()), pa.array([total[at : at + sent].tobytes()], pa.binary())],
                    names=["block", "part"],
                )

        return run

    def add(batches):
        total = {}
        for batch in batches:
            for block, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                value = np.frombuffer(part.as_buffer(), np.float32)
                if block not in total:
                    total[block] = value.astype(np.float64)
                else:
                    total[block] += value
        for block, value in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([value.tobytes()], pa.binary())], names=["block", "part"]
            )

    bands = [held.mapInArrow(tidy(band(low, min(terms, low + rows))), shape) for low in range(0, terms, rows)]
    summed = (each.repartition(n, "block").mapInArrow(tidy(add), shape) for each in bands)
    return stage(functools.reduce(DataFrame.union, summed), "latent-products")


def fit(docs: DataFrame, pieces: Pieces) -> Latent:
    spark = docs.sparkSession
    held = stage(_held_terms(docs, pieces), "latent-terms")
    frequency, n = _frequency(held, pieces)
    idf = np.log((n + 1) / (frequency + 1)) + 0.1
    weight = float(np.sqrt(max(1.0, n / max(1, len(pieces.words)))))
    own = [np.unique(w[w >= 0]).astype(_term_kind(pieces)) for w in pieces.words]
    own = [(np.concatenate(own).tobytes(), bytes(map(len, own)), weight)]
    own = spark.createDataFrame(own, "terms binary, sizes binary, weight double")
    # the most frequent terms first
    order = np.argsort(idf, kind="stable")
    matrix = _products(held.withColumn("weight", F.lit(1.0)).union(own), pieces, idf, order)

    def times(right: np.ndarray):
        """The product of the matrix and ``right``, which has a row for each term in order."""

        def product(batch):
            total = np.zeros_like(right)
            for block, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = np.frombuffer(part.as_buffer(), np.float64).reshape(-1, len(right))
                at = np.arange(block, block + len(rows))
                total[at] += rows @ right
                total += rows.T @ right[at]
                total[at] -= rows[at - block, at][:, None] * right[at]
            return total

        return product

    rank = min(RANK, len(pieces.terms))
    draw = np.random.default_rng(0).normal(size=(len(pieces.terms), min(len(pieces.terms), rank + OVERSAMPLE)))
    draw = draw[order]
    for _ in range(2):
        draw, _ = np.linalg.qr(_summed(matrix, pieces, times(draw)))
    values, turned = np.linalg.eigh(draw.T @ _summed(matrix, pieces, times(draw)))
    right = np.empty((len(order), rank))
    right[order] = draw @ turned[:, np.argsort(-values)[:rank]]
    unit = np.zeros((len(pieces.words), len(pieces.terms)))
    for row, w in zip(unit, pieces.words, strict=True):
        row[w] = idf[w]
    whole = np.linalg.norm(unit, axis=1)
    unit /= whole[:, None]
    right = widened(right, unit)
    space = (right * idf[:, None]).astype(np.float32)
    return Latent(idf, float(np.median(idf)), space, (unit @ right).astype(np.float32), whole.astype(np.float32))


def common_subsequence(masks: dict[int, int], size: int, sequence) -> int:
    """Length of the longest common subsequence, bit by bit; ``masks`` has the places of each word in the piece."""
    full = (1 << size) - 1
    state = full
    for word in sequence:
        mask = masks.get(word)
        if mask:
            hit = state & mask
            state = ((state + hit) | (state - hit)) & full
    return size - state.bit_count()


def projected(ids: np.ndarray, half: np.ndarray, n: int, latent: Latent) -> np.ndarray:
    """The sum of the terms' rows of the space in each of ``n`` half windows, and a row of zeros.

    The ``COMMON`` most frequent terms, most of the words, are counted per half window, and one matrix product sums them.
    """
    known = np.flatnonzero(ids >= 0)
    term, at = ids[known], half[known]
    common = np.argsort(latent.idf, kind="stable")[:COMMON]
    place = np.full(len(latent.idf), -1)
    place[common] = np.arange(len(common))
    often = place[term] >= 0
    count = np.bincount(at[often] * len(common) + place[term[often]], minlength=n * len(common))
    out = np.zeros((n + 1, latent.space.shape[1]), np.float32)
    out[:n] = count.reshape(n, len(common)).astype(np.float32) @ latent.space[common]
    term, at = term[~often], at[~often]
    if len(term):
        begins = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        count = np.diff(np.append(begins, len(term)))
        # the first of each half window, then the second, and so on
        for nth in range(int(count.max())):
            some = begins[count > nth] + nth
            out[at[some]] += latent.space[term[some]]
    return out


def _leaks(docs: DataFrame, pieces: Pieces, latent: Latent) -> DataFrame:
    masks, counts = [], []
    for held in pieces.words:
        places: dict[int, int] = {}
        for i, word in enumerate(held.tolist()):
            places[word] = places.get(word, 0) | 1 << i
        masks.append(places)
        counts.append({w: m.bit_count() for w, m in places.items()})

    def run(batches):
        for batch in slices(batches, 1):
            h, row = hashed_words(batch.column(1))
            ids = pieces.ids(h)
            half, owner, start = passages(ids, row, batch.num_rows)
            doc, item, word, cosine, share = [], [], [], [], []
            n = len(owner)
            if n:
                project = projected(ids, half, n, latent)
                square = np.zeros(n + 1)
                square[:n] = np.bincount(half, np.where(ids >= 0, latent.idf[ids], latent.other) ** 2, n)
                joined = np.concatenate([owner[1:] == owner[:-1], [False]])
                project[:n][joined] += project[1:][joined]
                square[:n][joined] += square[1:][joined]
                length = np.sqrt(np.maximum(square[:n], 1e-9)).astype(np.float32)
                for low in range(0, n, PASSAGES):
                    some = slice(low, low + PASSAGES)
                    close = project[:n][some] @ latent.piece.T
                    counted = np.minimum(length[some, None], latent.length)
                    close /= counted
                    last = -1
                    for p, i in zip(*(x.tolist() for x in np.nonzero(close >= COSINE)), strict=True):
                        best = min(1.0, float(close[p, i]))
                        whole = float(close[p, i] * counted[p, i] / length[low + p])
                        p += low
                        if p != last:
                            last, text = p, owner[p]
                            a = max(start[p] - HALF, np.searchsorted(row, text))
                            b = min(start[p] + WINDOW + HALF, np.searchsorted(row, text, "right"))
                            near = ids[a:b].tolist()
                            held = set(near)
                        size = len(pieces.words[i])
                        least = PARAPHRASE if size >= SHORT else 1
                        # no subsequence is longer than the places of the piece whose words are there
                        if sum(map(counts[i].__getitem__, held & counts[i].keys())) / size < least:
                            continue
                        found = common_subsequence(masks[i], size, near) / size
                        if found < least:
                            continue
                        answer = pieces.answer[i]
                        has = np.isin(answer, near).mean() >= 0.5 if len(answer) else True
                        if found >= VERBATIM or has and whole >= COSINE:
                            doc.append(batch.column(0)[int(text)].as_py())
                            item.append(pieces.item[i])
                            word.append(int(start[p] - np.searchsorted(row, text)))
                            cosine.append(best)
                            share.append(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(item, pa.int64()), pa.array(word, pa.int64()),
                 pa.array(cosine, pa.float64()), pa.array(share, pa.float64())],
                names=["doc_id", "item_id", "word", "cosine", "overlap"],
            )

    shape = "doc_id long, item_id long, word long, cosine double, overlap double"
    return docs.select("doc_id", "text").mapInArrow(tidy(run), shape)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and benchmark item that it holds: where (first word of the passage, the earliest one),
    the best cosine, and the share of a piece that the passage has in order. Clean documents have no row."""
    spark = docs.sparkSession
    benchmark = benchmark.select("item_id", "text")
    blocks = -(-benchmark.count() // BLOCK)
    found = spark.createDataFrame([], "doc_id long, item_id long, word long, cosine double, overlap double")
    for block in range(blocks):
        own = benchmark.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block) if blocks > 1 else benchmark
        pieces = Pieces.of(sorted(((r.item_id, r.text) for r in own.collect()), key=str))
        for part in pieces.spaces():
            found = found.union(_leaks(docs, part, fit(docs, part)))
    return found.groupBy("doc_id", "item_id").agg(
        F.min("word").alias("word"), F.max("cosine").alias("cosine"), F.max("overlap").alias("overlap")
    )


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item."""
    held = leaks(docs, benchmark).select("doc_id").distinct()
    return docs.join(stage(held, "leaking"), "doc_id", "left_anti").select(*docs.columns)
