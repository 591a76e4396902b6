"""The trie of conversations against one built turn by turn."""

import collections
import hashlib
import random
import zlib

import pytest

from tillroll.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, key string"


def brute(rows, family=5, most=9):
    """Nodes of the rebuilt conversations, by walking every prefix."""
    held = collections.defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            said = f"{len((role or '').encode())}:{role or ''}{text or ''}"
            key = (turn is not None, turn or 0, role or "", hashlib.sha256(said.encode()).hexdigest()[:32])
            held[conv].append((key, (role or "", text or "")))
    held = {conv: [x[1] for x in sorted(turns, key=lambda x: x[0])] for conv, turns in held.items()}
    rebuilt = held
    if family:
        rebuilt = {}
        for conv, turns in held.items():
            first = conv - (abs(conv) % family) * (1 if conv >= 0 else -1)
            h = zlib.crc32(str(conv).encode()) % most
            rebuilt[conv] = held.get(first, [])[:h] + turns[h:]
    members = collections.defaultdict(list)
    for conv, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
    children = collections.defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    found = []

    def below(path):
        own = (len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0
        parts = [below(x) for x in children[path]]
        leaves = sum(x[0] for x in parts) or 1
        saved = own + sum(x[1] for x in parts)
        ends = ",".join(str(c) for c in sorted(members[path]) if len(rebuilt[c]) == len(path))
        found.append(
            (min(members[path]), len(path), min(members[path[:-1]]) if path else None, len(members[path]),
             len(children[path]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
        )
        return leaves, saved

    if rebuilt:
        below(())
    return sorted(found, key=str)


def _rows(df):
    return sorted((tuple(row) for row in df.collect()), key=str)


def _random(seed, convs, longest, words="ab", roles=("user", "assistant", None)):
    draw = random.Random(seed)
    rows = []
    for conv in range(convs):
        for turn in range(draw.randint(1, longest)):
            at = draw.choice([turn, turn, turn, None])
            rows.append((conv, at, draw.choice(roles), draw.choice([*words, None, "", "é" * 3]), 1, "x"))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_rows", [1, 7, 1000])
def test_random_conversations(spark, shard_rows):
    """Shards of one row to all rows: most nodes run over shards, or none does."""
    rows = _random(shard_rows, 60, 6)
    turns = spark.createDataFrame(rows, SCHEMA)
    assert _rows(trie.trie(turns, shard_rows=shard_rows)) == brute(rows, family=0)
    assert _rows(trie.branched_trie(turns, shard_rows=shard_rows)) == brute(rows)


@pytest.mark.parametrize("shard_rows", [3, 1000])
def test_copies_and_long_conversations(spark, shard_rows):
    """A third of the conversations are one and the same, some run over several blocks of the matrix."""
    rows = [(c, t, "user", f"turn {t}", 0, "") for c in range(40) for t in range(3 * trie.WIDTH + 1)]
    rows += [(c, t, "user", f"turn {t}" if t < 20 + c % 3 * trie.WIDTH else "else", 0, "") for c in range(50, 70)
             for t in range(c)]
    rows += [(c, 0, "system", "alone", 0, "") for c in range(100, 105)]
    turns = spark.createDataFrame(rows, SCHEMA)
    assert _rows(trie.trie(turns, shard_rows=shard_rows)) == brute(rows, family=0)
    assert _rows(trie.branched_trie(turns, shard_rows=shard_rows)) == brute(rows)


def test_odd_rows(spark):
    """Nulls, repeated and tied rows, turnless conversations, long texts, conversations without the first of their family."""
    rows = [
        (None, 0, "user", "nobody's", 0, ""), (3, None, None, None, 0, ""), (3, None, "", "", 0, ""),
        (8, 1, "user", "a", 0, ""), (8, 1, "user", "a", 0, ""), (8, 1, "assistant", "b", 0, ""), (-7, 2, "user", "ü", 0, ""),
        (-5, 2, "user", "ü" * 70_000, 0, ""), (11, 0, "ab", "c", 0, ""), (12, 0, "a", "bc", 0, ""), (2**40, 5, "u", "v", 0, ""),
    ]
    turns = spark.createDataFrame(rows, SCHEMA)
    assert _rows(trie.branched_trie(turns)) == brute(rows)
    assert _rows(trie.trie(turns, shard_rows=2)) == brute(rows, family=0)


def test_only_turnless_and_no_conversations(spark):
    one = [c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 1][:4]
    rows = [(c, 0, "user", "gone", 0, "") for c in one]
    turns = spark.createDataFrame(rows, SCHEMA)
    assert _rows(trie.branched_trie(turns)) == brute(rows)
    assert trie.branched_trie(turns.filter("conv_id is null")).collect() == []


def test_digest_of_many_ends(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 3)
    rows = [(c, 0, "user", "same", 0, "") for c in range(500)]
    turns = spark.createDataFrame(rows, SCHEMA)
    assert _rows(trie.trie(turns, shard_rows=40)) == brute(rows, family=0)
