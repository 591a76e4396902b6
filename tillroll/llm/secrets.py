"""Secret scans: fixed rules, and a character convolutional network over every other candidate.

Rules give the base spans: ``assign`` (a password, token or key that is set to a value), ``access`` (access key ids) and
``hex`` (long lower-case hexadecimal runs). Candidates are all other runs of ``LEAST`` token characters or more, plain
words too: it is the network that rejects those. It reads a candidate's characters with those around it, a long one in
overlapping windows of which the highest counts, and adds the span as ``model`` when its calibrated probability reaches
the threshold. Every candidate is read at every place with the characters around it. Candidates that stand close show the
same characters, so the convolution is taken once at each place of a text, and a candidate's maxima and means come from
the places it shows (``_Reader``).

The network learns from labelled findings: candidates that a rule covers are secrets, the others are not. Every different
value of the table is a finding. Rules see names such as ``token=`` and few formats, while the network is asked where no
name stands and about any format. So each secret also stands recoded in other alphabets and lengths, in surroundings
taken from other findings or in none, and words also stand joined, capitalised and numbered. Three quarters of all
findings, chosen by their hashes, are trained on in shares of about ``SHARE``: tasks train side by side from the same
weights, and the driver averages what they come to, pass by pass. The last quarter is kept from training and shown as it
is scanned; the probabilities are calibrated on all of it (Platt), and the threshold is the highest one that still
finds the share ``RECALL`` of all secrets among it. Without findings of both labels no spans are added.

Offsets are code points, ends exclusive. A null text counts as an empty one and has no spans. Repeated rows are scanned
each; a column named ``spans`` is an error, others stay.
"""

from __future__ import annotations

import dataclasses
import functools
import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.ranking import bracketed_quantiles
from tillroll.functions.staging import owned_stages, stage
from tillroll.llm.text import NOT_ALNUM, added, rolling, slices, span_hash, tidy, utf8, wider, words

# The rules and their order.
KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Candidates: runs of token characters of this length or more.
LEAST = 6
#: A text with a longer run may hold an access key id or a hexadecimal run.
LONG_RUN = 20
_NOT_TOKEN = NOT_ALNUM.copy()
_NOT_TOKEN[128:] = True
_NOT_TOKEN[[ord(c) for c in "+/_=-"]] = False
_LETTER = ~NOT_ALNUM
_LETTER[[*range(48, 58), *range(128, 256)]] = False

#: How many of each kind ``findings`` shows; nothing is learned from that selection.
FINDINGS = 2_000
RECALL = 0.97
#: One finding in so many is kept from training, for calibration.
KEPT = 4
#: Draws of the kept ones, of which that with the most even share is taken.
DRAWS = 8
#: Findings that a task trains on, those a task holds back before it hands them on, and windows seen in training at least.
SHARE, HELD_BACK, SEEN = 65_536, 50_000, 250_000
#: Alphabets and lengths that secrets are recoded in, and how often.
ALPHABETS = (
    "0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "abcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyz",
)
LENGTHS = (12, 16, 20, 24, 32, 40)
#: The numbers that a recoded form is drawn by: its alphabet, length and characters.
_DRAWS = struct.Struct(f"<{3 + max(LENGTHS)}I")
#: Recoded forms that the secrets have together in a pass, at the least; at least four each. Others have this many each.
RECODED, OTHERS_EACH = 8_000, 4
BEFORE, INSIDE, AFTER = 24, 40, 8
WIDTH = BEFORE + INSIDE + AFTER
ALPHABET = 97
#: What the network reads of a character, by its code point, and how many windows are turned into these at once.
_CODES = np.full(128, 96, np.uint8)
_CODES[0], _CODES[32:127] = 0, np.arange(1, 96)
CODED = 4_096
EMBED, FILTERS, REACH, BATCH = 12, 48, 5, 128
#: Passes over all findings: so many that ``SEEN`` windows are seen, within these bounds.
PASSES = (2, 48)
#: Places of a text that the convolution is taken at together while it is scanned.
PLACES = 4_096
#: What the network reads of a character, by the first byte of its UTF-8.
_BYTE_CODES = np.concatenate([_CODES, np.full(128, 96, np.uint8)])


def rule_spans(text: str) -> list[tuple[int, int, str]]:
    """Base spans (start, end, kind), leftmost and not overlapping within a kind."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def windows(before: str, value: str, after: str) -> list[str]:
    """What the network reads of a candidate: the characters before it, its own, those after it, each of a fixed width.

    A long value is read in several windows that overlap by half; inner ones show no surroundings.
    """
    last = max(0, len(value) - INSIDE)
    starts = sorted({*range(0, last, INSIDE // 2), last})
    shown = []
    for at in starts:
        left = before[-BEFORE:] if at == 0 else ""
        right = after[:AFTER] if at == last else ""
        shown.append(left.rjust(BEFORE, "\0") + value[at : at + INSIDE].ljust(INSIDE, "\0") + right.ljust(AFTER, "\0"))
    return shown


def coded(shown: list[str]) -> np.ndarray:
    """0: nothing, 1 to 95: printable ASCII, 96: anything else."""
    codes = np.empty((len(shown), WIDTH), np.uint8)
    for at in range(0, len(shown), CODED):
        some = shown[at : at + CODED]
        points = np.frombuffer("".join(some).encode("utf-32-le"), np.uint32)
        codes[at : at + CODED] = _CODES[np.minimum(points, 127)].reshape(len(some), WIDTH)
    return codes


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclasses.dataclass
class Network:
    """Embedding, one convolution with ReLU, maxima and means over the places that are not blank, one output."""

    embed: np.ndarray
    kernel: np.ndarray
    shift: np.ndarray
    out: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 0.5

    @property
    def gate(self) -> float:
        """The probability below which a candidate is turned away: the threshold, as none is before it is read."""
        return self.threshold

    @classmethod
    def new(cls, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        return cls(
            rng.normal(0, 0.3, (ALPHABET, EMBED)).astype(np.float32),
            rng.normal(0, (2 / (REACH * EMBED)) ** 0.5, (REACH * EMBED, FILTERS)).astype(np.float32),
            np.zeros(FILTERS, np.float32),
            rng.normal(0, 0.1, 2 * FILTERS + 1).astype(np.float32),
        )

    @staticmethod
    def _seen(x: np.ndarray) -> np.ndarray:
        """The places at which the convolution reads a character."""
        any_ = x > 0
        places = x.shape[1] - REACH + 1
        return functools.reduce(np.logical_or, [any_[:, i : places + i] for i in range(REACH)])

    def forward(self, x: np.ndarray):
        e, places = self.embed[x], x.shape[1] - REACH + 1
        spread = np.concatenate([e[:, i : places + i] for i in range(REACH)], axis=2)
        seen = self._seen(x)
        z = (spread.reshape(-1, REACH * EMBED) @ self.kernel).reshape(len(x), places, FILTERS)
        z += self.shift
        a = np.maximum(z, 0, out=z)
        a *= seen[:, :, None]
        top = a.argmax(axis=1)
        share = (1 / np.maximum(seen.sum(axis=1), 1)).astype(a.dtype)
        pooled = np.hstack([np.take_along_axis(a, top[:, None], 1)[:, 0], a.sum(axis=1) * share[:, None]])
        return spread, a, top, pooled, pooled @ self.out[:-1] + self.out[-1], share

    def tables(self) -> list[np.ndarray]:
        """What pairs of characters, and the last one, add at a place of the convolution."""
        each = [self.embed @ self.kernel[i * EMBED : (i + 1) * EMBED] for i in range(REACH)]
        pairs = [(each[i][:, None] + each[i + 1][None]).reshape(-1, FILTERS) for i in range(0, REACH - 1, 2)]
        return [x.astype(np.float32) for x in (*pairs, each[-1] + self.shift)]

    def logits(self, x: np.ndarray, tables: list[np.ndarray] | None = None) -> np.ndarray:
        """The network's output, read from ``tables``; windows may be narrower than ``WIDTH``.

        Columns that are blank in all of some windows are not read: those of like widths are taken together.
        """
        *pairs, last = tables or self.tables()
        out = np.empty(len(x), np.float32)
        for rows, part in trimmed(x) if x.shape[1] == WIDTH else [(np.arange(len(x)), x)]:
            width = np.minimum(part.shape[1], ((part > 0) * np.arange(REACH, REACH + part.shape[1], dtype=np.int8)).max(axis=1, initial=REACH))
            order = np.argsort(width, kind="stable")
            for at in range(0, len(order), 512):
                mine = order[at : at + 512]
                some = part[mine, : width[mine[-1]]].astype(np.int64)
                places = some.shape[1] - REACH + 1
                z = last[some[:, REACH - 1 :]]
                for i, table in enumerate(pairs):
                    z += table[some[:, 2 * i : places + 2 * i] * ALPHABET + some[:, 2 * i + 1 : places + 2 * i + 1]]
                seen = self._seen(some)
                np.maximum(z, 0, out=z)
                z *= seen[:, :, None]
                mean = z.sum(axis=1) / np.maximum(seen.sum(axis=1), 1)[:, None]
                out[rows[mine]] = np.hstack([z.max(axis=1), mean]) @ self.out[:-1] + self.out[-1]
        return out

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return _sigmoid(self.scale[0] * logits + self.scale[1])

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> list[np.ndarray]:
        """The slopes of the mean loss, or of the sum of the losses times their weights."""
        spread, a, top, pooled, logit, share = self.forward(x)
        each = 1 / len(y) if weight is None else weight
        d = ((_sigmoid(logit) - y) * each).astype(self.out.dtype)
        d_pooled = d[:, None] * self.out[None, :-1]
        places = a.shape[1]
        open_ = a > 0
        d_z = open_ * (d_pooled[:, FILTERS:] * share[:, None])[:, None]
        n, f = np.arange(len(x))[:, None], np.arange(FILTERS)
        d_z[n, top, f] += d_pooled[:, :FILTERS] * open_[n, top, f]
        slopes = d_z.reshape(-1, FILTERS)
        d_spread = (slopes @ self.kernel.T).reshape(len(x), places, REACH * EMBED)
        # of each character first, as several places of the convolution read it
        d_e = np.zeros((*x.shape, EMBED), d_z.dtype)
        for i in range(REACH):
            d_e[:, i : i + places] += d_spread[:, :, i * EMBED : (i + 1) * EMBED]
        flat, d_e = x.ravel(), d_e.reshape(-1, EMBED).T.copy()
        d_embed = np.stack([np.bincount(flat, part, ALPHABET) for part in d_e], axis=1).astype(self.embed.dtype)
        d_kernel = spread.reshape(-1, REACH * EMBED).T @ slopes
        return [d_embed, d_kernel, slopes.sum(axis=0), np.append(pooled.T @ d, d.sum())]

    def train(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rng, moments: Moments, steps: int) -> None:
        """One pass by Adam; ``steps`` are those of all passes, over which the rate falls."""
        held = [self.embed, self.kernel, self.shift, self.out]
        for some in np.array_split(rng.permutation(len(x)), max(1, len(x) // BATCH)):
            moments.step += 1
            rate = 0.004 * max(0.0, 1 - moments.step / (steps + 1)) + 1e-4
            each = weight[some] / weight[some].sum()
            slopes = None
            for rows, narrow in trimmed(x[some]):
                part = self.gradients(narrow, y[some[rows]], each[rows])
                slopes = part if slopes is None else [g + h for g, h in zip(slopes, part, strict=True)]
            for w, g, m, v in zip(held, slopes, moments.first, moments.second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**moments.step)) / (np.sqrt(v / (1 - 0.999**moments.step)) + 1e-8)


@dataclasses.dataclass
class Moments:
    """What Adam keeps between two steps, in the order embed, kernel, shift, out."""

    first: list[np.ndarray]
    second: list[np.ndarray]
    step: int = 0

    @classmethod
    def none(cls, network: Network) -> Moments:
        held = [network.embed, network.kernel, network.shift, network.out]
        return cls([np.zeros_like(w) for w in held], [np.zeros_like(w) for w in held])


def trimmed(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and rows, in parts without columns that are blank and that the network would not see.

    Four blanks part two characters as well as forty do: a place of the convolution reads ``REACH`` columns.
    """
    edge, short = REACH - 1, 12
    after = BEFORE + INSIDE
    brief = ~x[:, BEFORE + short : after].any(axis=1)
    alone = brief & ~x[:, :BEFORE].any(axis=1) & ~x[:, after:].any(axis=1)
    columns = np.arange(WIDTH)
    shapes = (
        (alone, columns[BEFORE - edge : BEFORE + short + edge]),
        (brief & ~alone, np.r_[columns[: BEFORE + short + edge], columns[after:]]),
        (~brief, columns),
    )
    return [(rows, x[np.ix_(rows, kept)]) for rows, kept in ((np.flatnonzero(m), kept) for m, kept in shapes) if len(rows)]


class _Runs:
    """The candidates of a slice: their places in bytes and in characters, and a hash of each value."""

    def __init__(self, column: pa.Array):
        self.data, self.bounds = utf8(column)
        starts, ends, row = words(self.data, self.bounds, _NOT_TOKEN)
        self.longest = np.zeros(len(column), np.int64)
        np.maximum.at(self.longest, row, ends - starts)
        some = ends - starts >= LEAST
        self.starts, self.ends, self.row = starts[some], ends[some], row[some]

    @functools.cached_property
    def hash(self) -> np.ndarray:
        return span_hash(rolling(self.data), self.starts, self.ends)

    @functools.cached_property
    def character(self) -> np.ndarray:
        """The number of the character that each byte belongs to, through all texts, and how many there are."""
        return np.append(np.cumsum((self.data & 0xC0) != 0x80) - 1, np.count_nonzero((self.data & 0xC0) != 0x80))

    def characters(self, some: np.ndarray) -> list[tuple[int, int, int]]:
        """Row, start and end of candidates, in characters."""
        start = self.character[self.starts[some]] - self.character[self.bounds[self.row[some]]]
        size = self.ends[some] - self.starts[some]
        return list(zip(self.row[some].tolist(), start.tolist(), (start + size).tolist(), strict=True))

    def letters_only(self) -> np.ndarray:
        count = np.concatenate([[0], np.cumsum(_LETTER[self.data])])
        return count[self.ends] - count[self.starts] == self.ends - self.starts

    def values(self, some: np.ndarray) -> np.ndarray:
        """The characters of values of at most ``INSIDE``, as the network takes them, blank on both sides."""
        size = self.ends[some] - self.starts[some]
        place = np.arange(INSIDE)
        at = np.minimum(self.starts[some][:, None] + place, len(self.data) - 1)
        code = np.where(place < size[:, None], self.data[at] - np.uint8(31), np.uint8(0))
        return np.pad(code, ((0, 0), (REACH - 1, REACH - 1)))


def _has_rules(texts: pa.Array, runs: _Runs) -> np.ndarray:
    """Which texts can have a base span at all: they hold a long run or one of the names."""
    found = runs.longest >= LONG_RUN
    for i, text in enumerate(texts.to_pylist()):
        if text and not found[i]:
            low = text.lower()
            found[i] = any(name in low for name in NAMES)
    return found


def different(docs: DataFrame, column: str = "text") -> DataFrame:
    """(kind, key, before, value, after): a finding of each different value of the whole table.

    Kinds are 0: covered by a rule, 1: letters, 2: others. A value that a rule covers somewhere is a secret everywhere.
    """

    def run(batches):
        held: dict[int, tuple] = {}
        for batch in slices(batches):
            texts = batch.column(0)
            runs = _Runs(texts)
            known = {int(i): rule_spans(texts[int(i)].as_py()) for i in np.flatnonzero(_has_rules(texts, runs))}
            plain = runs.letters_only()
            ruled = np.isin(runs.row, list(known))
            _, one = np.unique(runs.hash, return_index=True)
            # of a value that a rule covers anywhere, every place counts
            maybe = np.unique(np.concatenate([one, np.flatnonzero(ruled)]))
            strings = texts.to_pylist()
            each = zip(runs.hash[maybe].tolist(), plain[maybe].tolist(), runs.characters(maybe), strict=True)
            for key, letters, (i, start, end) in each:
                covered = i in known and any(a < end and start < b for a, b, _ in known[i])
                if covered or key not in held:
                    text, kind = strings[i], 0 if covered else 1 if letters else 2
                    found = (kind, text[max(0, start - BEFORE) : start], text[start:end], text[end : end + AFTER])
                    held[key] = min(found, held.get(key, found))
            if len(held) > HELD_BACK:
                yield _finding_rows(held)
                held = {}
        if held:
            yield _finding_rows(held)

    rows = docs.select(column).mapInArrow(tidy(run), "kind int, key long, before string, value string, after string")
    one = F.min(F.struct("kind", "before", "value", "after")).alias("one")
    return rows.groupBy("key").agg(one).select("one.*", "key")


def _finding_rows(held: dict[int, tuple]) -> pa.RecordBatch:
    kind, before, value, after = zip(*held.values(), strict=True)
    keys = np.array(list(held), np.uint64) ^ np.uint64(1 << 63)  # signed in the same order
    return pa.RecordBatch.from_arrays(
        [pa.array(kind, pa.int32()), pa.array(keys.view(np.int64)), pa.array(before, pa.string()),
         pa.array(value, pa.string()), pa.array(after, pa.string())],
        names=["kind", "key", "before", "value", "after"],
    )


def findings(docs: DataFrame, column: str = "text") -> DataFrame:
    """Of each kind of ``different`` values the ``FINDINGS`` with the smallest keys, to look at."""
    rows = different(docs, column)
    parts = [rows.filter(F.col("kind") == kind).orderBy("key").limit(FINDINGS) for kind in range(3)]
    return functools.reduce(DataFrame.union, parts)


def recoded(value: str, n: int) -> str:
    """The ``n``-th form of a secret in another alphabet and length, drawn from the digest of the two."""
    which, length, more, *draws = _DRAWS.unpack(hashlib.shake_256(f"{n}:{value}".encode()).digest(_DRAWS.size))
    letters, size = ALPHABETS[which % len(ALPHABETS)], LENGTHS[length % len(LENGTHS)]
    size += more % 5 - 2 if size < 40 else 0
    return "".join([letters[i % len(letters)] for i in draws[:size]])


def varied(word: str, other: str, n: int) -> str:
    """A word joined, capitalised or numbered, as names, paths and versions are."""
    forms = (
        word.upper(), word.lower(), word.capitalize() + other.capitalize(), word.lower() + other.capitalize(),
        f"{word}-{other}", f"{word}_{other}", f"{word}/{other}", f"{word}{n % 97}", f"{other}-{n % 9}-{n % 31}",
        f"{word.upper()}_{other.upper()}", f"{word}{other}".lower(), f"{word}={n % 1000}", f"20{n % 30:02d}-{1 + n % 12:02d}-{1 + n % 28:02d}",
        f"--{word}-{other}--", f"{word}/{other}/{n % 50}",
    )
    return forms[n % len(forms)]


def _examples(
    secret: list[tuple], others: list[tuple], rng: np.random.Generator, forms: range, turn: int | None = None
) -> tuple[list[str], np.ndarray]:
    """Windows and labels: each finding as it stands; secrets, recoded ones and varied words in other surroundings.

    An other finding is shown in one of its three ways, the next one with each ``turn``, or in all without it.
    """
    shown, label = [], []

    def add(before: str, value: str, after: str, is_secret: bool) -> None:
        for one in windows(before, value, after):
            shown.append(one)
            label.append(is_secret)

    def around() -> tuple[str, str]:
        if not others or rng.random() < 0.4:
            return "", ""
        before, _, after = others[rng.integers(len(others))]
        return before, after

    for before, value, after in secret:
        for one in (value, *(recoded(value, n) for n in forms)):
            b, a = around()
            add(b, one, a, True)
        add(before, value, after, True)
    letters = [value for _, value, _ in others if value.isalpha()] or ["word"]
    for n, (before, value, after) in enumerate(others):
        way = None if turn is None else (n + turn) % 3
        if way in (None, 0):
            add(before, value, after, False)
        if way in (None, 1):
            add("", value, "", False)
        if way in (None, 2):
            b, a = around()
            add(b, varied(letters[n % len(letters)], letters[rng.integers(len(letters))], n), a, False)
    return shown, np.array(label, np.float32)


def _labelled(batches) -> tuple[list[tuple], list[tuple]]:
    """The secrets and the other findings of a share, by key."""
    rows = sorted(row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns), strict=True))
    return [row[2:] for row in rows if row[1] == 0], [row[2:] for row in rows if row[1] > 0]


def _weights(network: Network, moments: Moments) -> bytes:
    held = [network.embed, network.kernel, network.shift, network.out, *moments.first, *moments.second]
    return np.concatenate([w.ravel() for w in held]).astype(np.float64).tobytes()


def _loaded(data: np.ndarray, network: Network, moments: Moments) -> None:
    held = [network.embed, network.kernel, network.shift, network.out, *moments.first, *moments.second]
    ends = np.cumsum([w.size for w in held])[:-1]
    for w, part in zip(held, np.split(data, ends), strict=True):
        w[...] = part.reshape(w.shape)


def _trained(rows: DataFrame, secrets_: int, others: int) -> Network:
    """A network trained on all ``rows``, share by share, the shares' weights averaged after each round."""
    n = secrets_ + others
    shares = -(-n // SHARE)
    forms = max(4, max(RECODED, others // OTHERS_EACH) // secrets_)
    windows_ = secrets_ * (forms + 2) + others
    passes = max(PASSES[0], min(PASSES[1], -(-SEEN // windows_)))
    weight = max(1.0, others / (secrets_ * (forms + 2)))
    # one share needs no averaging, so its passes are one round
    rounds, each = (1, passes) if shares == 1 else (passes, 1)
    steps = passes * max(1, windows_ // shares // BATCH)
    network = Network.new(0)
    moments = Moments.none(network)
    dealt = rows.withColumn("share", F.pmod("key", F.lit(shares))).repartition(shares, "share")
    dealt = dealt.select("key", "kind", "before", "value", "after")

    def one_round(at: int, step: int, start: bytes):
        def run(batches):
            secret, other = _labelled(batches)
            if not secret and not other:
                return
            own, kept = Network.new(0), Moments.none(Network.new(0))
            _loaded(np.frombuffer(start, np.float64), own, kept)
            kept.step, rng, seen = step, np.random.default_rng([at, len(other)]), 0
            for turn in range(at, at + each):
                shown, y = _examples(secret, other, rng, range(turn * forms, (turn + 1) * forms), turn)
                own.train(coded(shown), y, np.where(y > 0, weight, 1.0).astype(np.float32), rng, kept, steps)
                seen += len(y)
            yield pa.RecordBatch.from_arrays(
                [pa.array([seen], pa.int64()), pa.array([kept.step], pa.int64()), pa.array([_weights(own, kept)], pa.binary())],
                names=["seen", "step", "weights"],
            )

        return run

    for at in range(0, rounds * each, each):
        run = one_round(at, moments.step, _weights(network, moments))
        made = dealt.mapInArrow(tidy(run), "seen long, step long, weights binary").collect()
        made.sort(key=lambda r: (r.seen, bytes(r.weights)))
        total = sum(np.frombuffer(bytes(r.weights), np.float64) * r.seen for r in made)
        _loaded(total / sum(r.seen for r in made), network, moments)
        moments.step = max(r.step for r in made)
    return network


def _calibrated(network: Network, rows: DataFrame, secrets_: int, others: int) -> Network:
    """Platt's scale and shift by Newton steps, then the threshold, of all ``rows``."""
    forms = max(4, RECODED // secrets_)

    def run(batches):
        for batch in batches:
            secret, other = _labelled([batch])
            rng = np.random.default_rng(len(other))
            # as they are scanned: without the names that rules see
            shown, y = _examples([("", value, "") for _, value, _ in secret], other, rng, range(forms))
            z = network.logits(coded(shown))
            yield pa.RecordBatch.from_arrays(
                [pa.array(y.astype(np.int32)), pa.array(z.astype(np.float64))], names=["role", "z"]
            )

    columns = rows.select("key", "kind", "before", "value", "after")
    logits = stage(columns.mapInArrow(tidy(run), "role int, z double"), "secret-logits")
    n = {r.role: r.n for r in logits.groupBy("role").agg(F.count("*").alias("n")).collect()}
    # both labels count the same, however many words there are
    share = F.when(F.col("role") == 1, F.lit(1 / n[1])).otherwise(F.lit(1 / n[0]))
    target = F.when(F.col("role") == 1, F.lit((n[1] + 1) / (n[1] + 2))).otherwise(F.lit(1 / (n[0] + 2)))
    scale = np.array([1.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + F.exp(-(F.col("z") * float(scale[0]) + float(scale[1]))))
        curve, slope, z = share * p * (1 - p), share * (p - target), F.col("z")
        sums = [F.sum(curve * z * z), F.sum(curve * z), F.sum(curve), F.sum(slope * z), F.sum(slope)]
        zz, z1, one, gz, g1 = logits.agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).first()
        hessian = np.array([[zz, z1], [z1, one]]) + 1e-6 * np.eye(2)
        step = np.clip(np.linalg.solve(hessian, np.array([gz, g1]) + 1e-6 * (scale - [1.0, 0.0])), -1, 1)
        scale = scale - step
        if np.abs(step).max() < 1e-6:
            break
    scale[0] = max(scale[0], 1e-3)
    network.scale = (float(scale[0]), float(scale[1]))

    at = int((1 - RECALL) * n[1]) / max(1, n[1] - 1)
    found = bracketed_quantiles(logits.filter("role = 1"), ["z"], [at]).first()["value"]
    network.threshold = float(_sigmoid(scale[0] * found + scale[1]))
    return network


def fit(docs: DataFrame, column: str = "text") -> Network | None:
    """The network, trained and calibrated on all findings; None when those of one label are too few to learn from."""
    with owned_stages(docs.sparkSession):
        rows = stage(different(docs, column), "secret-findings")
        secret = F.col("kind") == 0
        kept = [F.pmod(F.xxhash64("key", F.lit(draw)), F.lit(KEPT)) == 0 for draw in range(DRAWS)]
        counts = [F.count_if(label & one).alias(f"{name}{i}") for i, one in enumerate(kept) for name, label in (("s", secret), ("o", ~secret))]
        n = rows.agg(F.count_if(secret).alias("secrets"), F.count_if(~secret).alias("others"), *counts).first()
        if min(n.secrets, n.others) < 10:
            return None
        # of few findings a draw may keep too many or none
        draw = min(range(DRAWS), key=lambda i: abs(KEPT * n[f"s{i}"] / n.secrets - 1) + abs(KEPT * n[f"o{i}"] / n.others - 1))
        secrets_, others = n[f"s{draw}"], n[f"o{draw}"]
        if not min(secrets_, others):
            return None
        network = _trained(rows.filter(~kept[draw]), n.secrets - secrets_, n.others - others)
        return _calibrated(network, rows.filter(kept[draw]), secrets_, others)


class _Reader:
    """The network's word on candidates where they stand, from a convolution that is taken once at each place of a text.

    A window shows up to ``BEFORE`` characters, the value, blanks, and up to ``AFTER`` characters. Its places up to the
    value's last ``REACH`` characters are places of the text, and so are those within the characters after it. Between them
    lie the places that read the value's end and blanks, or blanks and what comes after; these are few different ones.
    """

    def __init__(self, network: Network):
        self.network, (*self.pairs, self.last) = network, network.tables()
        self.room = np.empty((2, 0, FILTERS), np.float32)

    def _convolved(self, codes: np.ndarray, room: np.ndarray | None = None) -> np.ndarray:
        """The convolution at each place of rows of codes, 0 where all is blank, in the first half of ``room``."""
        places = codes.shape[-1] - REACH + 1
        two = codes[..., :-1].astype(np.intp) * ALPHABET + codes[..., 1:]
        z, more = np.empty((2, *codes.shape[:-1], places, FILTERS), np.float32) if room is None else room
        self.last.take(codes[..., REACH - 1 :], axis=0, out=z, mode="clip")
        for i, table in enumerate(self.pairs):
            z += table.take(two[..., 2 * i : places + 2 * i], axis=0, out=more, mode="clip")
        more[:] = 0
        np.maximum(z, more, out=z)
        blank = codes == 0
        if blank.any():
            z[np.logical_and.reduce([blank[..., i : places + i] for i in range(REACH)])] = 0
        return z

    def _edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of rows of codes the maxima, the sum that the means are made of, and at how many places not all is blank."""
        z = self._convolved(codes)
        return z.max(axis=1), z.sum(axis=1) @ self.network.out[FILTERS:-1], Network._seen(codes).sum(axis=1)

    @staticmethod
    def _keys(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first of each different row of ``REACH - 1`` codes, and which of them each row is."""
        key = codes.astype(np.int64) @ (1 << 7 * np.arange(REACH - 1))
        return np.unique(key, return_index=True, return_inverse=True)[1:]

    def logits(self, runs: _Runs, some: np.ndarray) -> np.ndarray:
        """The network's output for candidates in order whose values leave ``REACH - 1`` blanks or more in a window."""
        out, edge = np.empty(len(some), np.float32), REACH - 1
        if not len(some):
            return out
        lead = (runs.data & 0xC0) != 0x80
        # each text between blanks, so that places beyond its ends show blanks
        count = np.diff(runs.character[runs.bounds])
        codes = np.zeros(int(count.sum()) + BEFORE * (len(count) + 1) + edge, np.uint8)
        codes[np.arange(int(count.sum())) + BEFORE * np.repeat(np.arange(1, len(count) + 1), count)] = _BYTE_CODES[runs.data[lead]]
        start = runs.character[runs.starts[some]] + BEFORE * (runs.row[some] + 1)
        end = start + runs.ends[some] - runs.starts[some]
        blank = np.zeros((1, edge), np.uint8)
        one, tail = self._keys(codes[end[:, None] - edge + np.arange(edge)])
        size = (runs.ends - runs.starts)[some[one]]
        shown = runs.values(some[one])[np.arange(len(one))[:, None], size[:, None] + np.arange(2 * edge)]
        tails = self._edges(shown)
        after = codes[end[:, None] + np.arange(edge)]
        one, head = self._keys(after)
        heads = self._edges(np.hstack([np.repeat(blank, len(one), 0), after[one]]))
        weight = self.network.out[:FILTERS], self.network.out[FILTERS:-1]
        # the part of the candidates that stand within each stretch of places
        parts = np.searchsorted(start, np.arange(0, int(start[-1]) + 1 + PLACES, PLACES))
        for low, high in zip(parts[:-1].tolist(), parts[1:].tolist(), strict=True):
            if low == high:
                continue
            first = int(start[low]) - BEFORE
            part = codes[first : int(end[high - 1]) + AFTER]
            n = len(part) - edge
            if n > self.room.shape[1]:
                self.room = np.empty((2, n, FILTERS), np.float32)
            z, more = self.room[:, :n]
            self._convolved(part, (z, more))
            total = np.concatenate([[0], np.cumsum(z @ weight[1], dtype=np.float64)])
            seen = np.concatenate([[0], np.cumsum(Network._seen(part[None])[0])])
            a, b, e = start[low:high] - BEFORE - first, end[low:high] - edge - first, end[low:high] - first
            t, h = tail[low:high], head[low:high]
            # maxima over stretches of 2, 4, 8 and 16 places
            two = np.maximum(z[:-1], z[1:], out=more[:-1])
            four = np.maximum(two[:-2], two[2:], out=z[:-3])
            top = four[e]
            eight = np.maximum(four[:-4], four[4:], out=more[:-7])
            most = np.maximum(eight[:-8], eight[8:], out=z[:-15])
            np.maximum(top, most[a], out=top)
            np.maximum(top, most[b - 16], out=top)
            wide = np.flatnonzero(b - a > 32)
            for on in (16, 32):
                top[wide] = np.maximum(top[wide], most[np.minimum(a[wide] + on, b[wide] - 16)])
            np.maximum(top, tails[0][t], out=top)
            np.maximum(top, heads[0][h], out=top)
            mean = total[b] - total[a] + total[e + edge] - total[e] + tails[1][t] + heads[1][h]
            mean /= seen[b] - seen[a] + seen[e + edge] - seen[e] + tails[2][t] + heads[2][h]
            out[low:high] = top @ weight[0] + mean + self.network.out[-1]
        return out

    def probability(self, texts: pa.Array, runs: _Runs, some: np.ndarray) -> np.ndarray:
        """The calibrated probability of candidates, of a long one the highest of its windows."""
        z = np.full(len(some), -np.inf, np.float32)
        short = runs.ends[some] - runs.starts[some] <= INSIDE - REACH + 1
        z[short] = self.logits(runs, some[short])
        long = np.flatnonzero(~short)
        asked, shown = [], []
        for n, (i, start, end) in zip(long.tolist(), runs.characters(some[long]), strict=True):
            text = texts[i].as_py()
            for one in windows(text[max(0, start - BEFORE) : start], text[start:end], text[end : end + AFTER]):
                asked.append(n)
                shown.append(one)
        if shown:
            np.maximum.at(z, asked, self.network.logits(coded(shown), [*self.pairs, self.last]))
        return self.network.probability(z)


def _not_covered(runs: _Runs, known: dict[int, list[tuple[int, int, str]]]) -> np.ndarray:
    """Numbers of the candidates that no base span covers."""
    free = np.ones(len(runs.row), bool)
    ruled = np.flatnonzero(np.isin(runs.row, [i for i, spans in known.items() if spans]))
    for n, (i, start, end) in zip(ruled.tolist(), runs.characters(ruled), strict=True):
        free[n] = not any(a < end and start < b for a, b, _ in known[i])
    return np.flatnonzero(free)


def scan(docs: DataFrame, network: Network | None, column: str = "text") -> DataFrame:
    """Adds ``spans``: start, end, kind and, of the network's, the probability; by start, then kind."""
    schema = wider(docs, spans="array<struct<start:int,end:int,kind:string,probability:double>>")
    place = docs.columns.index(column)
    kind = pa.list_(
        pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("probability", pa.float64())])
    )

    def run(batches):
        reader = _Reader(network) if network else None
        for batch in slices(batches, place):
            texts = batch.column(place)
            runs = _Runs(texts)
            known = {int(i): rule_spans(texts[int(i)].as_py()) for i in np.flatnonzero(_has_rules(texts, runs))}
            spans = [[(a, b, name, None) for a, b, name in known.get(i, ())] for i in range(len(texts))]
            if reader and len(runs.starts):
                asked = _not_covered(runs, known)
                probability = reader.probability(texts, runs, asked)
                high = np.flatnonzero(probability >= network.threshold)
                for (i, start, end), p in zip(runs.characters(asked[high]), probability[high].tolist(), strict=True):
                    spans[i].append((start, end, "model", p))
            for found in spans:
                found.sort(key=lambda s: (s[0], KINDS.index(s[2])))
            rows = [[dict(zip(("start", "end", "kind", "probability"), s, strict=True)) for s in x] for x in spans]
            yield added(batch, {"spans": pa.array(rows, kind)})

    return docs.mapInArrow(tidy(run), schema)


def joined(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def digest(docs: DataFrame, network: Network | None) -> DataFrame:
    found = scan(docs.select("doc_id", "text"), network)
    count = lambda name: F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long")
    return found.select(
        "doc_id",
        *(count(name).alias(f"n_{name}") for name in KINDS[:3]),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "model")).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
