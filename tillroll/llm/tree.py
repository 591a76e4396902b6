"""BPE encoding and decoding of a tokenizer file, long unsplit text by tree concatenation.

The tokenizers library splits a text into units (special tokens, then its split pattern) and merges within each unit. A
unit of more than ``LEAF`` bytes is halved down to leaves; all leaves of a slice are encoded in one batch call, side by
side. Then neighbours are joined up the tree: a window of the last tokens of the left side and the first of the right is
encoded anew, and grows until its first token is the left side's and its last token the right side's. Two encodings that
share a token join to the encoding of the whole: the first merge across a border of the joined tokens would be the
next merge of one of the two sides too. So the ids are those of the library, whatever the leaves.

Texts are first cut before single spaces between visible characters, which no split pattern of the GPT-2 family
crosses, and each distinct piece is encoded once. Pieces are told apart by hash; that the hashes told true is seen by
putting the slice together again from its distinct pieces.

Nulls and empty texts have no tokens and decode to the empty text. Rows keep all their columns, repeated rows and clashing
ids included; a column named like a new one is an error. Texts of any length are encoded whole.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tillroll.llm.bpe import byte_alphabet, gathered
from tillroll.llm.text import added, rolling, slices, span_hash, tidy, utf8, wider

#: Bytes of a unit that are encoded in one go.
LEAF = 128
#: Tokens on each side of a join in the first window.
WINDOW = 2
#: Distinct pieces a worker remembers before it starts anew; bounds memory, not results.
PIECES_KEPT = 400_000


class Vocabulary:
    """The tokenizer of a file, its merges alone, and the bytes of all tokens by id."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merges = Tokenizer(self.tokenizer.model)
        with open(path, encoding="utf-8") as file:
            self.special = [x["content"] for x in json.load(file)["added_tokens"]]
        ids = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ids = {name: ids[name] for name in self.special}
        back = {c: b for b, c in enumerate(byte_alphabet())}
        self.shown = [""] * (max(ids.values()) + 1)
        data = [b""] * len(self.shown)
        for name, i in ids.items():
            self.shown[i] = name
            known = name not in self.ids and all(c in back for c in name)
            data[i] = bytes(back[c] for c in name) if known else name.encode()
        self.bounds = np.concatenate([[0], np.cumsum([len(x) for x in data])])
        self.data = np.frombuffer(b"".join(data), np.uint8)

    def merged(self, units: list[str]) -> list[list[int]]:
        """Ids of units that are short or windows, in one batch."""
        return [x.ids for x in self.merges.encode_batch_fast(units, add_special_tokens=False)] if units else []


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def halves(unit: str, leaf: int) -> list[str]:
    """``unit`` cut in half until no part is longer than ``leaf``; a power of two of parts."""
    parts = [unit]
    while max(map(len, parts)) > leaf:
        parts = [half for x in parts for half in (x[: len(x) // 2], x[len(x) // 2 :])]
    return parts


def join(v: Vocabulary, pairs: list[tuple[list[int], list[int]]], window: int = WINDOW) -> list[list[int]]:
    """The encoding of the bytes of each pair of neighbours, both sides encoded on their own."""
    done: list = [None] * len(pairs)
    waiting, k = list(range(len(pairs))), window
    while waiting:
        across = v.merged(
            ["".join(v.shown[i] for i in pairs[p][0][-k:] + pairs[p][1][:k]) for p in waiting]
        )
        still = []
        for p, new in zip(waiting, across, strict=True):
            left, right = pairs[p]
            agree_left = k >= len(left) or new[0] == left[-k]
            agree_right = k >= len(right) or new[-1] == right[k - 1]
            if agree_left and agree_right:
                done[p] = left[:-k] + new + right[k:]
            else:
                still.append(p)
        waiting, k = still, 2 * k
    return done


def concatenated(v: Vocabulary, units: list[str], leaf: int = LEAF) -> list[list[int]]:
    """Ids of each unit (a text in the byte alphabet that merges freely), all trees level by level."""
    cut = [halves(unit, leaf) for unit in units]
    flat = iter(v.merged([part for parts in cut for part in parts]))
    trees = [[next(flat) for _ in parts] for parts in cut]
    while any(len(tree) > 1 for tree in trees):
        open_ = [t for t, tree in enumerate(trees) if len(tree) > 1]
        pairs = [(trees[t][i], trees[t][i + 1]) for t in open_ for i in range(0, len(trees[t]), 2)]
        joined = iter(join(v, pairs))
        for t in open_:
            trees[t] = [next(joined) for _ in range(len(trees[t]) // 2)]
    return [tree[0] for tree in trees]


def _parts(v: Vocabulary, piece: str) -> list[str]:
    """``piece`` cut at special tokens, which are parts of their own; the earliest and longest first."""
    parts, rest = [], piece
    while rest:
        found = [(rest.find(x), -len(x), x) for x in v.special if x in rest]
        if not found:
            return [*parts, rest]
        at, _, name = min(found)
        parts += [rest[:at]] * (at > 0) + [name]
        rest = rest[at + len(name) :]
    return parts


def long_pieces(v: Vocabulary, pieces: list[str], leaf: int = LEAF) -> list[list[int]]:
    """Ids of pieces in which a unit may be long: split as the library does, then merged by trees."""
    units, of, out = [], [], [[] for _ in pieces]
    for p, piece in enumerate(pieces):
        for part in _parts(v, piece):
            if part in v.ids:
                of.append((p, v.ids[part]))
                continue
            for unit, _ in v.tokenizer.pre_tokenizer.pre_tokenize_str(part):
                of.append((p, None))
                units.append(unit)
    ids = iter(concatenated(v, units, leaf))
    for p, special in of:
        out[p] += next(ids) if special is None else [special]
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True


def cuts(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces begin: before each text, and before one space that stands between two visible characters.

    The second result tells the latter from the former.
    """
    n = len(data)
    blank = _SPACE[data]
    if n > 2:  # the white space beyond ASCII
        a, b, c = data[:-2], data[1:-1], data[2:]
        wide = (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
        wide |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | np.isin(c, (0xA8, 0xA9, 0xAF))) | (b == 0x81) & (c == 0x9F))
        for shift in range(3):
            blank[shift : n - 2 + shift] |= wide
    if n > 1:
        wide = (data[:-1] == 0xC2) & np.isin(data[1:], (0x85, 0xA0))
        blank[:-1] |= wide
        blank[1:] |= wide
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    alone = np.zeros(n, bool)
    alone[1:-1] = (data[1:-1] == 0x20) & ~blank[:-2] & ~blank[2:] & ~first[1 : n - 1] & ~first[2:n]
    places = np.flatnonzero(alone | first[:n])
    return places, alone[places]


class Pieces:
    """Ids of the pieces a worker has met, in flat arrays: found by hash, proved by their bytes."""

    def __init__(self, v: Vocabulary, leaf: int):
        self.v, self.leaf, self.length = v, leaf, v.bounds[1:] - v.bounds[:-1]
        self.clear()

    def clear(self) -> None:
        self.keys, self.number = np.empty(0, np.uint64), np.empty(0, np.int64)  # in the order of the keys
        self.held, self.held_at = np.empty(0, np.uint8), np.zeros(1, np.int64)  # bytes by number
        self.ids, self.ids_at = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's begin."""
        if len(self.keys) > PIECES_KEPT:
            self.clear()
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(bounds), np.int64)
        starts, inner = cuts(data, bounds)
        ends, joins = np.append(starts[1:], len(data)), inner & np.append(inner[1:], False)
        keys, one, which = np.unique(span_hash(rolling(data), starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        known[at < len(self.keys)] = self.keys[at[at < len(self.keys)]] == keys[at < len(self.keys)]
        fresh = one[~known]
        found = np.empty(len(keys), np.int64)
        found[known] = self.number[at[known]]
        if len(fresh):
            found[~known] = len(self.held_at) - 1 + np.arange(len(fresh))
            ids, begins = self.fresh(data, starts[fresh], ends[fresh], joins[fresh])
            held, held_at = _stretches(data, starts[fresh], ends[fresh])
            self.ids, self.ids_at = np.concatenate([self.ids, ids]), _appended(self.ids_at, begins)
            self.held, self.held_at = np.concatenate([self.held, held]), _appended(self.held_at, held_at)
            self.keys = np.insert(self.keys, at[~known], keys[~known])
            self.number = np.insert(self.number, at[~known], found[~known])
        wanted = found[which]
        again, _ = gathered(self.held, self.held_at, wanted)
        if np.array_equal(again, data):
            ids, begins = gathered(self.ids, self.ids_at, wanted)
        else:  # two pieces of one hash
            ids, begins = self.fresh(data, starts, ends, joins)
        return ids, begins[np.searchsorted(starts, bounds)]

    def fresh(self, data, starts, ends, joins) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces at these places, and where each piece's begin.

        Pieces that start with a single space and end before one are encoded as one text, for which the token lengths
        tell where a piece ends; the others one by one, long ones by trees.
        """
        size = ends - starts
        joins = joins & (size <= self.leaf)
        text, at = _stretches(data, starts[joins], ends[joins])
        batch = [text.tobytes().decode()] if len(text) else []
        together = np.array(self._plain(batch)[0] if batch else [], np.uint32)
        last = np.cumsum(self.length[together])
        cut = np.searchsorted(last, at[1:], "right")
        if len(cut) and not np.array_equal(last[cut - 1], at[1:]):
            raise ValueError("the split pattern of this tokenizer goes across single spaces between words")
        ids: list = [None] * len(starts)
        held = data.tobytes()
        short, long = (np.flatnonzero(~joins & few) for few in (size <= self.leaf, size > self.leaf))
        for some, way in ((short, self._plain), (long, lambda x: long_pieces(self.v, x, self.leaf))):
            texts = [held[starts[i] : ends[i]].decode() for i in some]
            for i, one in zip(some, way(texts) if texts else [], strict=True):
                ids[i] = np.array(one, np.uint32)
        counts = np.zeros(len(starts), np.int64)
        counts[joins] = np.diff(cut, prepend=0)
        for i in np.flatnonzero(~joins):
            counts[i] = len(ids[i])
        begins = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(begins[-1], np.uint32)
        out[np.repeat(joins, counts)] = together
        for i in np.flatnonzero(~joins):
            out[begins[i] : begins[i + 1]] = ids[i]
        return out, begins

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.v.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _stretches(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes from ``starts`` to ``ends`` one after the other, and where each stretch begins."""
    at = np.concatenate([[0], np.cumsum(ends - starts)])
    return data[np.arange(at[-1]) + np.repeat(starts - at[:-1], ends - starts)], at


def _appended(bounds: np.ndarray, more: np.ndarray) -> np.ndarray:
    return np.concatenate([bounds, bounds[-1] + more[1:]])


@functools.lru_cache(maxsize=2)
def pieces_of(path: str, leaf: int) -> Pieces:
    """One set of known pieces a worker; what it holds is bounded and changes no result."""
    return Pieces(vocabulary(path), leaf)


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Each stretch of ``values`` as the bytes it holds in memory."""
    offsets = (bounds * values.dtype.itemsize).astype(np.int64)
    held = pa.Array.from_buffers(
        pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]
    )
    return held.cast(pa.binary())


def _texts(v: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The decoded text of each stretch of ids; bytes that are no UTF-8 become U+FFFD."""
    data, begins = gathered(v.data, v.bounds, ids.astype(np.int64))
    held = _binary(data, begins[bounds])
    try:
        return held.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in held.to_pylist()], pa.string())


def encode(df: DataFrame, path: str, column: str = "text", *, decoded: bool = False, leaf: int = LEAF) -> DataFrame:
    """Adds ``ids``, the tokens of ``column`` as little-endian unsigned 32-bit integers in one binary value.

    With ``decoded`` the ids are decoded in the same pass (see ``decode``). ``leaf`` bounds the bytes of a unit that are
    encoded in one go and changes no result.
    """
    schema, place = wider(df, ids="binary", **({"decoded": "string"} if decoded else {})), df.columns.index(column)

    def run(batches):
        v, pieces = vocabulary(path), pieces_of(path, leaf)
        for batch in slices(batches, place):
            ids, begins = pieces.encode(*utf8(batch.column(place)))
            more = {"ids": _binary(ids.astype("<u4"), begins)}
            if decoded:
                more["decoded"] = _texts(v, ids, begins)
            yield added(batch, more)

    return df.mapInArrow(tidy(run), schema)


def decode(df: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """Adds ``decoded``, the text of the ids, special tokens included; a null has the empty text."""
    schema, place = wider(df, decoded="string"), df.columns.index(column)

    def run(batches):
        v = vocabulary(path)
        for batch in slices(batches, place):
            held = batch.column(place).fill_null(b"").cast(pa.large_binary())
            bounds = np.concatenate([[0], np.cumsum(pa.compute.binary_length(held).to_numpy())]) // 4
            ids = np.frombuffer(b"".join(held.to_pylist()), "<u4")
            yield added(batch, {"decoded": _texts(v, ids, bounds)})

    return df.mapInArrow(tidy(run), schema)


def digest(docs: DataFrame, path: str) -> DataFrame:
    """Per document the number of tokens and the digests of ids and of the decoded text."""
    return encode(docs.select("doc_id", "text"), path, decoded=True).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
