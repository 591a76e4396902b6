"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The rank file (one base64 token and its rank a line) becomes a byte-level BPE model: every byte stands as one printable
character, and each way to cut a token into two known tokens is a merge of that token's rank. Texts are cut before
single spaces, which the split pattern never crosses, so a distinct piece is encoded once as long as a task remembers it.

Token offsets come from the byte lengths of the tokens and a byte-to-character map of the text. Decoding reverses the
byte table; a token may hold part of a character, so bytes are joined before they are read as UTF-8.

Nulls and empty texts have no tokens and decode to the empty text. Rows keep all their columns.
"""

from __future__ import annotations

import base64
import functools
import itertools
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from tillroll.llm.text import added, slices, tidy, utf8, wider

#: Distinct pieces a task remembers before it forgets the rare ones; bounds memory, not results.
PIECES_KEPT = 250_000
#: Pieces that are encoded as one text.
JOINED = 256
#: Before one space between two visible characters: the pattern always splits there.
_CUT = re.compile(r"(?<=\S)(?= \S)")
#: A space that has white space beside it, which is no place to cut.
_WIDE = re.compile(r"\s | \s")


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself where it is printable Latin-1, else one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[Tokenizer, np.ndarray, np.ndarray]:
    """The tokenizer, the bytes of all tokens by id one after the other, and where each token's begin."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    shown = byte_alphabet()
    name = {token: "".join(shown[b] for b in token) for token in ranks}
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
        for cut in range(1, len(token)):
            left, right = token[:cut], token[cut:]
            if ranks.get(left, rank) < rank and ranks.get(right, rank) < rank:
                merges.append((name[left], name[right]))
    model = models.BPE(vocab={name[token]: rank for token, rank in ranks.items()}, merges=merges, ignore_merges=True)
    tokenizer = Tokenizer(model)
    split = pre_tokenizers.Split(Regex(public_tokenizers.PATTERN), "isolated")
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
        [split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    back = {c: b for b, c in enumerate(shown)}
    by_id = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        by_id[rank] = bytes(back[c] for c in name[token])
    bounds = np.concatenate([[0], np.cumsum([len(token) for token in by_id])])
    return tokenizer, np.frombuffer(b"".join(by_id), np.uint8), bounds


def gathered(values: np.ndarray, bounds: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``values`` with the ``wanted`` numbers one after the other, and where each begins."""
    size = (bounds[1:] - bounds[:-1])[wanted]
    ends = np.cumsum(size)
    begins = np.concatenate([[0], ends])
    take = np.arange(begins[-1]) + np.repeat(bounds[wanted] - begins[:-1], size)
    return values[take], begins


def _cut(text: str | None) -> list[str]:
    """The text's pieces: cut before every single space between two visible characters."""
    if not text:
        return []
    if text[0] == " " or text[-1] == " " or _WIDE.search(text):
        return _CUT.split(text)
    first, *others = text.split(" ")
    return [first, *[" " + word for word in others]]


class _Pieces:
    """Ids of the pieces a task has met, flat, by number of the piece; when they grow too many, those met again stay."""

    def __init__(self, tokenizer: Tokenizer, length: np.ndarray):
        self.tokenizer, self.length = tokenizer, length
        self.number: dict[str, int] = {}
        self.ids = np.empty(1 << 16, np.int32)
        self.bounds = np.zeros(1 << 16, np.int64)
        self.met = np.zeros(1 << 16, np.int64)

    def thin(self) -> None:
        """Forgets the pieces that were met once since they were last thinned, and of the others the rarer ones."""
        met = self.met[: len(self.number)]
        again = np.flatnonzero(met > 1)
        stay = np.sort(again[np.argsort(-met[again], kind="stable")[: PIECES_KEPT // 2]])
        ids, bounds = gathered(self.ids, self.bounds[: len(self.number) + 1], stay)
        pieces = list(self.number)
        self.number = {pieces[n]: at for at, n in enumerate(stay.tolist())}
        self.ids[: len(ids)], self.bounds[: len(bounds)] = ids, bounds
        self.met[:] = 0

    def _encoded(self, fresh: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different pieces one after the other, and where each piece's end.

        Pieces that begin with a space and are visible on both sides are encoded as one text, ``JOINED`` at a time: the
        split pattern cuts them there, and where their bytes end tells which tokens are theirs.
        """
        whole = [len(p) > 1 and p[0] == " " and p.strip() == p[1:] for p in fresh]
        joined = [p for p, one in zip(fresh, whole, strict=True) if one]
        texts = ["".join(joined[at : at + JOINED]) for at in range(0, len(joined), JOINED)]
        texts += [p for p, one in zip(fresh, whole, strict=True) if not one]
        fresh[:] = joined + [p for p, one in zip(fresh, whole, strict=True) if not one]
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.concatenate([np.asarray(x.ids, np.int32) for x in found])
        size = pc.binary_length(pa.array(fresh, pa.large_string())).to_numpy(zero_copy_only=False)
        return ids, np.searchsorted(np.cumsum(self.length[ids]), np.cumsum(size)) + 1

    def _add(self, fresh: list[str]) -> None:
        at = len(self.number)
        ids, ends = self._encoded(fresh)
        ends += self.bounds[at]
        while at + len(fresh) >= len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
            self.met = np.concatenate([self.met, np.zeros_like(self.met)])
        while ends[-1] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.bounds[at] : ends[-1]] = ids
        self.bounds[at + 1 : at + 1 + len(fresh)] = ends
        self.number.update(zip(fresh, range(at, at + len(fresh)), strict=True))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's begin."""
        if len(self.number) > PIECES_KEPT:
            self.thin()
        cut = [_cut(text) for text in texts]
        pieces = list(itertools.chain.from_iterable(cut))
        wanted = np.fromiter(map(self.number.get, pieces, itertools.repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(wanted < 0)
        if len(missing):
            unknown = [pieces[i] for i in missing.tolist()]
            self._add(list(dict.fromkeys(unknown)))
            wanted[missing] = np.fromiter(map(self.number.__getitem__, unknown), np.int64, len(unknown))
        self.met[: len(self.number)] += np.bincount(wanted, minlength=len(self.number))
        of_text = np.concatenate([[0], np.cumsum([len(part) for part in cut])])
        ids, begins = gathered(self.ids, self.bounds[: len(self.number) + 1], wanted)
        return ids, begins[of_text]


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int32()))


def _bytes(ids: np.ndarray, bounds: np.ndarray, table: np.ndarray, token_bounds: np.ndarray) -> pa.Array:
    """The bytes of each stretch of ids, by the table of token bytes."""
    data, begins = gathered(table, token_bounds, ids)
    offset = pa.py_buffer(begins[bounds].astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, offset, pa.py_buffer(data)])


def encode(
    df: DataFrame, path: str, column: str = "text", offsets: bool = True, decoded: bool = False
) -> DataFrame:
    """Adds ``ids`` and, with ``offsets``, ``starts`` and ``ends``: each token's characters in the text.

    A character that several tokens share belongs to each of them: the span runs from the character that holds the
    token's first byte to the end of the one that holds its last. With ``decoded`` the ids are decoded in the same
    pass (see ``decode``), which spares their way through a second Python process.
    """
    kinds = {"ids": "array<int>"} | ({"starts": "array<int>", "ends": "array<int>"} if offsets else {})
    kinds |= {"decoded": "binary"} if decoded else {}
    schema, place = wider(df, **kinds), df.columns.index(column)

    def run(batches):
        tokenizer, table, token_bounds = vocabulary(path)
        length = token_bounds[1:] - token_bounds[:-1]
        pieces = _Pieces(tokenizer, length)
        for batch in slices(batches, place):
            ids, begins = pieces.encode(batch.column(place).to_pylist())
            more = {"ids": _lists(ids, begins)}
            if offsets:
                data, bounds = utf8(batch.column(place))
                character = np.cumsum((data & 0xC0) != 0x80) - 1
                last = np.cumsum(length[ids]) - 1
                text = np.repeat(np.arange(len(begins) - 1), begins[1:] - begins[:-1])
                base = character[bounds[text]] if len(ids) else np.empty(0, np.int64)
                starts = character[last - length[ids] + 1] - base if len(ids) else base
                ends = character[last] - base + 1 if len(ids) else base
                more |= {"starts": _lists(starts, begins), "ends": _lists(ends, begins)}
            if decoded:
                more["decoded"] = _bytes(ids, begins, table, token_bounds)
            yield added(batch, more)

    return df.mapInArrow(tidy(run), schema)


def decode(df: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """Adds ``decoded``, the bytes of the ids (UTF-8 if the ids are those of a whole text)."""
    schema, place = wider(df, decoded="binary"), df.columns.index(column)

    def run(batches):
        _, table, token_bounds = vocabulary(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = part.column(place).fill_null([])
                wanted = ids.flatten().to_numpy(zero_copy_only=False)
                bounds = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))])
                yield added(part, {"decoded": _bytes(wanted, bounds, table, token_bounds)})

    return df.mapInArrow(tidy(run), schema)


def digest(docs: DataFrame, path: str) -> DataFrame:
    """Per document the number of tokens and the digests of ids and of decoded bytes."""
    return encode(docs.select("doc_id", "text"), path, offsets=False, decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
