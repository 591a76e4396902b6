"""The pipeline against plain forms of its stages, each on what the stage before has kept."""

import base64
import hashlib

import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from tillroll.functions.staging import folder_names, shared_folder, stage
from tillroll.llm import contamination


@pytest.fixture(scope="module")
def kept(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = [("documents", docs.collect(), docs.columns)]
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, sf_dir), f"test-{name}")
        found.append((name, docs.collect(), docs.columns))
    return found


def texts(rows):
    return {r.doc_id: r.text for r in rows}


def test_columns_stay(kept):
    assert all(columns == kept[0][2] for _, _, columns in kept[:-1])
    assert [name for name, *_ in kept[1:]] == [name for name, _ in corpus_pipeline.STAGES]


def test_toxic_documents_go_and_clean_ones_stay(spark):
    """On a larger table: the smallest has nine confirmed toxic documents to learn from."""
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    left = texts(corpus_pipeline.toxic(spark, docs, sf_dir).collect())
    clean = [i for i, toxic in labels.items() if toxic == 0]
    assert sum(i in left for i in clean) >= 0.97 * len(clean)
    assert sum(i not in left for i, toxic in labels.items() if toxic) >= 0.7 * sum(labels.values())


def test_lines(kept):
    before, after = texts(kept[1][1]), texts(kept[2][1])
    assert before.keys() == after.keys()
    expected = brute.line_dedup(before)
    assert sum(after[i] != expected[i] for i in before) <= 0.01 * len(before)
    assert all(r.n_chars == len(r.text) for r in kept[2][1])


def test_one_of_each_group_stays(kept):
    before = texts(kept[2][1])
    groups = brute.jaccard_components(before)
    assert texts(kept[3][1]) == {i: before[i] for i, (_, group) in groups.items() if group == i}


def test_leaking_documents_go(spark, sf_dir, kept):
    fold = lambda t: " " + " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split()) + " "
    items = [fold(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    before, after = texts(kept[3][1]), texts(kept[4][1])
    leaking = {i for i, text in before.items() if any(item in fold(text) for item in items)}
    assert not leaking & after.keys()
    assert len(before.keys() - leaking - after.keys()) <= 0.01 * len(before)


def test_tokens(kept):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    before = texts(kept[4][1])
    assert sorted(r.doc_id for r in kept[5][1]) == sorted(before)
    for r in kept[5][1]:
        ids = plain.encode_ordinary(before[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(before[r.doc_id].encode()).hexdigest()


def test_run_gives_the_same(spark, sf_dir, kept):
    assert sorted(corpus_pipeline.run(spark, sf_dir).collect()) == sorted(kept[5][1])


def test_run_leaves_only_its_result(spark, sf_dir):
    folder = f"{shared_folder(spark)}/tillroll/{spark.sparkContext.applicationId}"
    before = set(folder_names(spark, folder))
    docs = corpus_pipeline.run(spark, sf_dir)
    left = set(folder_names(spark, folder)) - before
    assert len(left) == 1 and left.pop().startswith(f"pipeline-{corpus_pipeline.STAGES[-1][0]}")
    assert docs.count() > 0


ODD = [
    (1, None), (2, ""), (3, " \n\t"), (4, "one word each here is not like any other text of this table at all"),
    (5, " ".join(f"w{i}x{i * 7 % 13}" for i in range(40_000))), (6, "日本語の文章です。" * 3000), (7, "🙂" * 5000),
    (8, "the same text twice under one id and once under another, word for word, long enough to count"),
    (8, "the same text twice under one id and once under another, word for word, long enough to count"),
    (9, "the same text twice under one id and once under another, word for word, long enough to count"),
    (None, "a text of its own without any id, which says something no other text of the table has said"),
]


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
def test_odd_rows(spark, sf_dir, number):
    """Nulls, empty and very long texts, repeated rows and ids, and columns named like the stages' own."""
    name, step = corpus_pipeline.STAGES[number]
    rows = [(i, t, None, "s", 7, 0.5, "k", [1]) for i, t in ODD]
    schema = "doc_id long, text string, lang string, source string, toxicity int, component_id double, doc string, places array<int>"
    docs = spark.createDataFrame(rows, schema)
    found = step(spark, docs, sf_dir)
    held = found.collect()
    assert step(spark, docs.limit(0), sf_dir).count() == 0
    if number == len(corpus_pipeline.STAGES) - 1:
        assert sorted(str(r.doc_id) for r in held) == sorted(str(i) for i, _ in ODD)
        return
    assert found.columns == docs.columns
    assert all((r.toxicity, r.component_id, r.doc, r.places) == (7, 0.5, "k", [1]) for r in held)
    kept = [(r.doc_id, r.text) for r in held]
    copies = {8, 9} | ({None} if name == "jaccard_join" else set())
    expected = [x for x in ODD if x[0] not in copies]
    assert sorted((str(i), t or "") for i, t in kept if i not in copies) == sorted((str(i), t or "") for i, t in expected)
    if name == "line_dedup":  # rows of one id and text are one document; its copy under another id loses the line
        assert [t for i, t in kept if i in copies] == [ODD[7][1]] * 2 + [""]
    elif name == "jaccard_join":
        assert {i for i, _ in kept} >= {8} and 9 not in {i for i, _ in kept}
    else:
        assert sum(i in copies for i, _ in kept) == 3


def test_benchmark_items_are_sought_in_axes_of_all_documents(spark, tmp_path, monkeypatch):
    """Each document is one passage, so the matrix is easily made whole; its leading axis is that of the stage's space."""
    monkeypatch.setattr(contamination, "RANK", 1)
    monkeypatch.setattr(contamination, "OVERSAMPLE", 100)
    monkeypatch.setattr(contamination, "CAPTURED", -1)
    seen, fit = [], contamination.fit
    monkeypatch.setattr(contamination, "fit", lambda docs, pieces: seen.append((pieces, fit(docs, pieces))) or seen[-1][1])
    rng = np.random.default_rng(12)
    rows = [rng.choice(40, rng.integers(1, 30), replace=False).tolist() for _ in range(6000)]
    docs = spark.createDataFrame([(i, " ".join(f"w{x}" for x in row)) for i, row in enumerate(rows)], "doc_id long, text string")
    item = list(range(40))
    spark.createDataFrame([(0, " ".join(f"w{x}" for x in item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    corpus_pipeline.benchmark_items(spark, docs, str(tmp_path)).count()
    (pieces, latent), = seen
    place = pieces.ids(contamination.hashed_words(contamination.pa.array([" ".join(f"w{x}" for x in item)]))[0])
    x = np.zeros((len(rows) + 1, len(item)))
    for at, row in zip(x, [*rows, item], strict=True):
        at[place[row]] = latent.idf[place[row]]
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[-1] *= np.sqrt(len(rows))
    axis = np.linalg.eigh(x.T @ x)[1][:, -1]
    assert abs(axis @ (latent.space[:, 0] / latent.idf)) > 1 - 1e-7
