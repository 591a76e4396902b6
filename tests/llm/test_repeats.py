import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tillroll.llm import catalog, repeats

N = repeats.LENGTH


def expected(texts):
    """(bytes, removed, runs, digest) by counting every window."""
    raw = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + N] for r in raw for i in range(len(r) - N + 1))
    found = []
    for r in raw:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - N + 1):
            if count[r[i : i + N]] > 1:
                gone[i : i + N] = True
        runs = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(r) else 0
        kept = bytes(b for b, g in zip(r, gone, strict=False) if not g)
        found.append((len(r), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return found


def rows_of(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdé xyz") for _ in range(n))
    shared = [text(n) for n in (360, 399, 400, 420, 900, 1500)]
    texts = [None, "", "a" * 399, "a" * 400, "a" * 401, "ab" * 600, "é" * 300, text(5000)]
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            s = rng.choice(shared)
            parts += [text(rng.randrange(0, 500)), s[rng.randrange(0, 200) :] if rng.random() < 0.5 else s]
        texts.append("".join(parts))
    texts += [texts[7], texts[20], texts[20]]
    edited = list(texts[7])
    for at in range(0, 5000, 450):
        edited[at] = "#"
    return [*texts, "".join(edited)]


@pytest.mark.parametrize("seed", range(2))
def test_against_every_window(make_docs, seed):
    texts = corpus(seed)
    assert rows_of(repeats.digest(make_docs(texts))) == dict(enumerate(expected(texts)))


def test_large_buckets_are_counted(make_docs, monkeypatch):
    monkeypatch.setattr(repeats, "MEMBERS", 3)
    monkeypatch.setattr(repeats, "TOGETHER", 5)
    monkeypatch.setattr(repeats, "BOUNDED", 2)
    monkeypatch.setattr(repeats, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(repeats, "PIECE", 1000)
    texts = corpus(5)
    assert rows_of(repeats.digest(make_docs(texts))) == dict(enumerate(expected(texts)))


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    rows = rows_of(catalog.registered()["op9_repeated_passages"](spark, sf_dir))
    assert rows == dict(zip([r.doc_id for r in docs], expected([r.text for r in docs]), strict=True))


def test_empty_and_repeated_ids(make_docs):
    docs = make_docs(["ab" * 300, "x"])
    assert repeats.digest(docs.limit(0)).count() == 0
    rows = repeats.digest(docs.union(docs)).collect()
    assert sorted((r.doc_id, r.n_removed) for r in rows) == [(0, 600), (0, 600), (1, 0), (1, 0)]


def test_planted_passages_of_over_fifty_words(make_docs):
    """Of passages of 51 to 120 words in two documents each, all of 400 bytes and more go, whole, and no shorter one.

    What tells is the length in bytes, not in words, and ``n_removed``, not ``n_bytes``.
    """
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 10)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(rng.randrange(51, 121)) for _ in range(80)]
    texts = [f"{prose(40)} {p} {prose(40)}" for p in passages for _ in range(2)] + [prose(200) for _ in range(40)]
    rows = rows_of(repeats.digest(make_docs(texts)))
    long = [i for i, p in enumerate(passages) if len(p) + 2 >= N]
    assert 20 < len(long) < 70
    for i, p in enumerate(passages):
        for doc in (2 * i, 2 * i + 1):
            # the blanks around a passage are shared as well, and so may be a character or two beyond them
            assert rows[doc][1] == 0 if i not in long else len(p) + 2 <= rows[doc][1] <= len(p) + 6
    assert all(rows[i][1] == 0 for i in range(160, 200))
