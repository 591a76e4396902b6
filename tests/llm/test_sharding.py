import zlib

import numpy as np

from tillroll.llm import catalog, sharding


def check(rows, texts):
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    by_shard = {}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        by_shard.setdefault(r.shard, []).append(r)
    for held in by_shard.values():
        assert sorted(r.slot for r in held) == list(range(len(held)))
    return {s: sum(r.size for r in held) for s, held in by_shard.items()}


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = catalog.registered()["op7_vector_sharding"](spark, sf_dir).collect()
    load = check(rows, texts)
    assert set(load) == set(range(16)) and {r.law for r in rows} == {"bytes"}
    assert all(r.grown_shard is None for r in rows)
    largest = max(len((t or "").encode()) + 1 for t in texts.values())
    assert max(load.values()) <= sum(load.values()) / 16 + largest


def test_groups_stay_whole_and_hot_ones_are_split(make_docs):
    texts = ["hot hot"] * 400 + [f"pair {i // 2}" for i in range(200)] + [None, "", None]
    rows = sharding.assign(make_docs(texts), shards=4).collect()
    load = check(rows, dict(enumerate(texts)))
    assert max(load.values()) < 1.06 * sum(load.values()) / 4
    where = {}
    for r in rows:
        where.setdefault(texts[r.doc_id] or "", set()).add(r.shard)
    assert len(where.pop("hot hot")) > 1 and all(len(s) == 1 for s in where.values())


def test_packing_balances_all_resources():
    rng = np.random.default_rng(1)
    sizes = rng.gamma(2.0, 1.0, (4000, 3))
    placed = sharding.pack(sizes, 16)
    load = np.array([sizes[placed == s].sum(axis=0) for s in range(16)])
    assert (load.max(axis=0) / load.mean(axis=0) < 1.02).all()


def test_empty(make_docs):
    assert sharding.assign(make_docs(["x"]).filter("doc_id < 0")).count() == 0


def plain_pack(sizes, shards, weights):
    """Vector bin packing item by item in plain Python: the largest first, to where the dot product is highest."""
    fair = [max(sum(column) / shards, 1e-9) for column in zip(*sizes, strict=True)]
    shares = [[x / f for x, f in zip(row, fair, strict=True)] for row in sizes]
    room, where = [[1.0] * len(fair) for _ in range(shards)], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-max(shares[i]), i)):
        dots = [sum(r * w * x for r, w, x in zip(held, weights, shares[i], strict=True)) for held in room]
        where[i] = max(range(shards), key=lambda s: (dots[s], -s))
        room[where[i]] = [r - x for r, x in zip(room[where[i]], shares[i], strict=True)]
    return where


def test_packing_against_a_plain_form():
    rng = np.random.default_rng(4)
    for n, shards in ((1, 3), (40, 4), (300, 16)):
        sizes = rng.integers(1, 1 << 12, (n, 3)).astype(float)
        assert sharding.pack(sizes, shards).tolist() == plain_pack(sizes.tolist(), shards, sharding.WEIGHTS)


def test_null_ids_and_long_texts(make_docs, spark):
    texts = ["x " * 400_000, "日" * 100_000, *[f"doc {i}" for i in range(50)]]
    docs = make_docs(texts).unionByName(spark.createDataFrame(
        [(None, "no id", "en", "s", 5, 1), (None, None, None, None, None, None)],
        "doc_id long, text string, lang string, source string, n_chars long, score int"))
    rows = sharding.assign(docs, shards=4).collect()
    assert len(rows) == 54 and sum(r.doc_id is None for r in rows) == 2
    held = {}
    for r in rows:
        held.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(slots) == list(range(len(slots))) for slots in held.values())
