import random

import numpy as np
import pyarrow as pa
import pytest

from tillroll.llm import catalog, contamination


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(100):
        a = [rng.randrange(6) for _ in range(rng.randrange(1, 40))]
        b = [rng.randrange(6) for _ in range(rng.randrange(0, 60))]
        masks = {}
        for i, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << i
        assert contamination.common_subsequence(masks, len(a), b) == plain_lcs(a, b)


def test_passages_cover_every_word():
    h, row = contamination.hashed_words(pa.array(["a b " * 50, None, "", "x", "y " * 64]))
    half, owner, start = contamination.passages(h, row, 5)
    assert np.bincount(half).tolist() == [32, 32, 32, 4, 1, 32, 32]
    assert owner.tolist() == [0, 0, 0, 0, 3, 4, 4] and start.tolist() == [0, 32, 64, 96, 100, 101, 133]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    common = [f"c{i}" for i in range(60)]
    rare = lambda: f"r{rng.randrange(100_000)}"
    sentence = lambda n: [rng.choice(common) if rng.random() < 0.5 else rare() for _ in range(n)]
    items = [sentence(rng.choice([9, 25, 50, 150])) for _ in range(40)]
    benchmark = [(i, " ".join(w[:-4]) + ". " + " ".join(w[-4:])) for i, w in enumerate(items)]
    docs, truth = [], set()
    for i in range(400):
        words = sentence(rng.randrange(20, 400))
        if i % 10 == 0:
            item = i // 10
            at = rng.randrange(len(words))
            told = list(items[item])
            if i % 20 == 0:  # reworded: one word in six changes, the answer stays
                for j in range(0, len(told) - 4, 6):
                    told[j] = rare()
            docs.append(" ".join(words[:at] + told + words[at:]).upper() if i % 30 == 0 else "\n".join(words[:at] + told))
            truth.add((i, item))
        elif i % 10 == 1:
            docs.append(" ".join(words + items[i // 10][:3]))  # a few words only
        else:
            docs.append(" ".join(words))
    docs += [None, "", " ".join(items[1]) * 200]
    truth.add((402, 1))
    return (
        spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"),
        spark.createDataFrame([*benchmark, (90, None), (91, ""), (92, "c1")], "item_id long, text string"),
        truth,
    )


def test_planted_leaks(corpus):
    docs, benchmark, truth = corpus
    rows = contamination.leaks(docs, benchmark).collect()
    found = {(r.doc_id, r.item_id) for r in rows if r.item_id != 92}
    assert found == truth
    assert all(r.overlap >= contamination.PARAPHRASE and r.cosine >= contamination.COSINE for r in rows)


def test_blocks_and_empty_tables(corpus, monkeypatch):
    docs, benchmark, truth = corpus
    monkeypatch.setattr(contamination, "BLOCK", 15)
    rows = contamination.leaks(docs, benchmark.filter("item_id <> 92")).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == truth
    assert contamination.leaks(docs.limit(0), benchmark).count() == 0
    assert contamination.leaks(docs, benchmark.limit(0)).count() == 0
    assert contamination.remove(docs, benchmark.limit(0)).count() == docs.count()


def test_query_finds_every_whole_item(spark, sf_dir):
    """Against a plain search for the items' words in a row."""
    fold = lambda t: " " + " ".join("".join(c if c.isalnum() or ord(c) > 127 else " " for c in t.lower()).split()) + " "
    docs = {r.doc_id: fold(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r.item_id: fold(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    truth = {(d, i) for d, text in docs.items() for i, item in items.items() if item in text}
    rows = catalog.registered()["op10_latent_decontamination"](spark, sf_dir).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == truth


def test_widened_space_holds_every_piece():
    rng = np.random.default_rng(1)
    pieces = rng.random((150, 900))
    pieces /= np.linalg.norm(pieces, axis=1)[:, None]
    narrow = np.linalg.qr(rng.normal(size=(900, 20)))[0]
    right = contamination.widened(narrow, pieces)
    assert np.allclose(right.T @ right, np.eye(right.shape[1]))
    assert (((pieces @ right) ** 2).sum(axis=1) >= contamination.CAPTURED).all()
    assert contamination.widened(right, pieces) is right


def test_items_by_the_thousand(spark):
    """Every third item of 2,100 verbatim, every third reworded, and short items among many other words."""
    rng = np.random.default_rng(3)
    draw = lambda n: [f"w{x}" for x in np.minimum(rng.zipf(1.3, n), 30_000) - 1]
    items = [draw(45) if i % 50 else [f"s{i}", *draw(2)] for i in range(2100)]
    docs, truth = [], set()
    for i in range(0, 2100):
        told = list(items[i])
        if i % 50 and i % 3 == 1:  # one word in six changes, the answer stays
            told[0:41:6] = [f"n{x}" for x in rng.integers(0, 30_000, 7)]
        if i % 3 < 2:
            truth.add((i, i))
            docs.append((i, " ".join(draw(70) + told + [f"n{x}" for x in rng.integers(0, 30_000, 60)])))
    benchmark = [(i, " ".join(w[:-4]) + ". " + " ".join(w[-4:])) for i, w in enumerate(items)]
    benchmark = spark.createDataFrame(benchmark, "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = contamination.leaks(frame, benchmark).collect()
    assert truth <= {(r.doc_id, r.item_id) for r in rows}
    texts = dict(docs)
    for r in rows:
        if (r.doc_id, r.item_id) not in truth:
            item = items[r.item_id]
            needed = contamination.PARAPHRASE if len(item) >= contamination.SHORT else 1
            assert plain_lcs(item, texts[r.doc_id].split()) >= needed * len(item)


def test_projection_is_the_sum_of_the_terms():
    rng = np.random.default_rng(2)
    for terms, words, halves in ((700, 3000, 90), (40, 500, 20), (300, 0, 5)):
        latent = contamination.Latent(
            rng.random(terms), 1.0, rng.normal(size=(terms, 7)).astype(np.float32), np.zeros((0, 7)), np.zeros(0)
        )
        ids, half = rng.integers(-1, terms, words), np.sort(rng.integers(0, halves, words))
        want = np.zeros((halves + 1, 7))
        for i, h in zip(ids, half, strict=True):
            if i >= 0:
                want[h] += latent.space[i]
        assert np.allclose(contamination.projected(ids, half, halves, latent), want, atol=1e-4)


def test_recall_against_brute_force(spark):
    """The latent space loses hardly any leak that exact cosines over all terms, without a space, find."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    benchmark = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in contamination.leaks(docs, benchmark).collect()}
    exact = set()
    for part in contamination.Pieces.of(sorted((r.item_id, r.text) for r in benchmark.collect())).spaces():
        frequency, n = contamination.document_frequency(docs, part)
        idf = np.log((n + 1) / (frequency + 1)) + 0.1
        unit = np.zeros((len(part.words), len(idf)))
        for row, held in zip(unit, part.words, strict=True):
            row[held] = idf[held]
        length = np.linalg.norm(unit, axis=1)
        space = np.diag(idf).astype(np.float32)
        piece = (unit / length[:, None]).astype(np.float32)
        latent = contamination.Latent(idf, float(np.median(idf)), space, piece, length.astype(np.float32))
        exact |= {(r.doc_id, r.item_id) for r in contamination._leaks(docs, part, latent).collect()}
    print("recall", len(found & exact), "of", len(exact), "found", len(found))
    assert len(exact) > 10 and len(found & exact) >= 0.9 * len(exact)


def test_space_is_fitted_on_every_passage(spark, monkeypatch):
    """The leading axes against those of the whole matrix, in memory; rows are of three kinds, some of them thousands."""
    monkeypatch.setattr(contamination, "RANK", 2)
    monkeypatch.setattr(contamination, "OVERSAMPLE", 200)
    monkeypatch.setattr(contamination, "CAPTURED", -1)
    rng = np.random.default_rng(9)
    first = [(0, 0, 0, 33, 33, 66)[i % 6] for i in range(6000)]
    texts = [" ".join(f"w{x}" for x in rng.integers(at, at + 33, rng.integers(1, 90))) for at in first]
    items = [(i, " ".join(f"w{x}" for x in range(i, 100, 7))) for i in range(7)]
    pieces = contamination.Pieces.of(items)
    docs = spark.createDataFrame([*enumerate(texts), (6001, None), (6002, "")], "doc_id long, text string")
    frequency, n = contamination.document_frequency(docs, pieces)
    idf = np.log((n + 1) / (frequency + 1)) + 0.1
    rows, count = [], np.zeros(len(idf), int)
    for text in texts:
        ids = pieces.ids(contamination.hashed_words(pa.array([text]))[0])
        for at in range(0, len(ids), contamination.HALF):
            held = np.unique(ids[at : at + contamination.WINDOW])
            rows.append(np.zeros(len(idf)))
            rows[-1][held[held >= 0]] = idf[held[held >= 0]]
            count[held[held >= 0]] += 1
    assert n == len(rows) and (frequency == count).all()
    for words in pieces.words:
        rows.append(np.zeros(len(idf)))
        rows[-1][words] = idf[words]
    x = np.array(rows)
    x /= np.maximum(np.linalg.norm(x, axis=1), 1e-9)[:, None]
    x[-len(items) :] *= np.sqrt(n / len(items))
    values, axes = np.linalg.eigh(x.T @ x)
    assert (values[-2:] > 1.2 * values[-3:-1]).all()
    for cells, sent, frequent in ((1 << 24, 1 << 18, 256), (2000, 300, 16), (500, 50, 3)):
        monkeypatch.setattr(contamination, "CELLS", cells, raising=False)
        monkeypatch.setattr(contamination, "CELLS_SENT", sent, raising=False)
        monkeypatch.setattr(contamination, "FREQUENT", frequent, raising=False)
        latent = contamination.fit(docs, pieces)
        right = latent.space / latent.idf[:, None]
        assert np.allclose(latent.idf, idf) and right.shape == (len(idf), 2)
        assert np.linalg.svd(axes[:, -2:].T @ right)[1].min() > 1 - 1e-6, cells
