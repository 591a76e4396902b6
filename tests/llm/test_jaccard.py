import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from tillroll.llm import catalog, components, jaccard
from tillroll.llm.text import shingle_sets


def held(rows):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


def corpus(seed, families=12, common=0):
    """Chains of near copies, exact copies, shared passages and odd texts."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [word() for _ in range(40)]
    texts = [None, "", "  \n", "one", "ONE", "two words", "two  words", "a b c d", "a b c d e", "x " * 3000]
    for _ in range(families):
        base = [word() for _ in range(rng.randrange(3, 160))]
        for _ in range(rng.randrange(1, 9)):
            texts.append(" ".join(base))
            for _ in range(rng.randrange(1, max(2, len(base) // 60))):
                base[rng.randrange(len(base))] = word()
            if rng.random() < 0.3:
                base = base + [word() for _ in range(len(base) // 8)]
    for _ in range(common):
        texts.append(" ".join(passage + [word() for _ in range(rng.randrange(0, 30))]))
    texts += texts[10:14]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", range(3))
def test_against_all_pairs(make_docs, seed):
    texts = corpus(seed, 40, common=60)
    assert held(jaccard.join(make_docs(texts)).collect()) == brute.jaccard_components(dict(enumerate(texts)))


def test_small_tiles_and_no_leaders(make_docs, monkeypatch):
    """All links come from tiles, of many blocks, and very common shingles go last."""
    monkeypatch.setattr(jaccard, "TILE", 4)
    monkeypatch.setattr(jaccard, "LEAST_COMMON", 8)
    monkeypatch.setattr(jaccard, "GATHERED", 500)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(jaccard, "_leaders", lambda sets: sets.limit(0).selectExpr("sid as a", "sid as b"))
    texts = corpus(7, 25, common=50)
    assert held(jaccard.join(make_docs(texts)).collect()) == brute.jaccard_components(dict(enumerate(texts)))


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = catalog.registered()["op5_jaccard_tiles"](spark, sf_dir).collect()
    assert held(rows) == brute.jaccard_components(texts)


def test_empty_and_repeated_ids(make_docs):
    docs = make_docs(["a b c d e f", "a b c d e f"])
    assert jaccard.join(docs.filter("doc_id < 0")).count() == 0
    assert sorted(jaccard.join(docs.union(docs)).collect()) == [(0, 2, 0)] * 2 + [(1, 2, 0)] * 2


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(0)
    for _ in range(200):
        pool = rng.integers(0, 1 << 62, 400).astype(np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 300))) for _ in range(2))
        times = int(rng.choice([1, 8]))
        bits = [np.frombuffer(jaccard.bitmaps(x, np.array([0, len(x)]), times)[0], np.uint8) for x in (a, b)]
        width = min(map(len, bits))
        differ = int(np.bitwise_count(jaccard.folded(bits[0], width) ^ jaccard.folded(bits[1], width)).sum())
        assert len(np.intersect1d(a, b)) <= (len(a) + len(b) - differ) // 2


def test_shingle_sets_match_plain_form():
    texts = corpus(1) + ["é x  É\tb c\x0bd e", "A B\nc D e F"]
    shingle, bounds = shingle_sets(pa.array(texts))
    assert [len(brute.shingles(t)) for t in texts] == list(np.diff(bounds))


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(400, 440)]
    union = brute.Union()
    for a, b in edges:
        union.join(a, b)
    df = spark.createDataFrame(edges, "a long, b long")
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert {r.node: r.root for r in components.components(df).collect()} == {x: union.find(x) for x in nodes}
    assert components.components(df.limit(0)).count() == 0
