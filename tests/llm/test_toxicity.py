import numpy as np
import pyarrow as pa
import pytest

from tillroll.llm import catalog, toxicity
from tillroll.llm.text import held_out

BAD = ["scumbag", "idiot"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(3)
    plain = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 8 == 0
        text = list(rng.choice(plain, rng.integers(5, 80)))
        if toxic:
            text.insert(int(rng.integers(0, len(text))), BAD[i // 8 % 2])
        rows.append((i, " ".join(text)))
        if i < 700:
            labels.append((i, int(toxic), "clash"))
    labels += [labels[0], (5, None, "x")]
    docs = spark.createDataFrame(rows + [(900, None), (901, ""), (902, "idiot " * 20000)], "doc_id long, text string")
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int, text string")


def test_held_out_accuracy(corpus):
    docs, labels = corpus
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).withColumn("held_out", held_out()).collect()
    assert len(rows) == 903 and all(0 <= r.toxicity <= 1 for r in rows)
    fold = [r for r in rows if r.doc_id < 900 and (r.held_out or r.doc_id >= 700)]
    right = sum((r.toxicity >= 0.5) == (r.doc_id % 8 == 0) for r in fold)
    assert right / len(fold) > 0.97
    odd = {r.doc_id: r.toxicity for r in rows if r.doc_id >= 900}
    assert odd[902] > 0.5 > odd[900] == odd[901]


def test_no_positives_and_empty_tables(corpus):
    docs, labels = corpus
    model = toxicity.fit(docs, labels.filter("toxic = 0"))
    assert {r.toxicity for r in toxicity.score(docs, model).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, labels.limit(0))).count() == 0
    with pytest.raises(ValueError):
        toxicity.score(docs.withColumn("toxicity", docs.doc_id), model)


def test_risk_falls_and_hidden_positives_are_found():
    rng = np.random.default_rng(0)
    x_pos = np.hstack([np.ones((200, 1)), rng.integers(0, 2, (200, 5))]).astype(np.float32)
    mix = (rng.random((1000, 1)) < 0.2).astype(np.float32)
    x_unl = np.hstack([mix, rng.integers(0, 2, (1000, 5))]).astype(np.float32)
    w, b = toxicity.fit_nnpu(x_pos, x_unl, 0.2, 0)
    assert (((x_unl @ w + b) > 0) == (mix[:, 0] > 0)).mean() > 0.98


def test_gradient_of_the_risk():
    """Against differences of the risk, with the second part above zero and, where the gradient turns, below it."""
    rng = np.random.default_rng(6)
    seen = set()
    for _ in range(40):
        p, u = rng.normal(size=(30, 4)), rng.normal(size=(50, 4)) - 3 * rng.random()
        w, prior = rng.normal(size=5) * 2, rng.uniform(0.05, 0.9)
        positive, negative = toxicity.risk_parts(w, p, u, prior)
        seen.add(negative >= 0)
        aim = (lambda w: sum(toxicity.risk_parts(w, p, u, prior))) if negative >= 0 else (
            lambda w: -toxicity.risk_parts(w, p, u, prior)[1]
        )
        step = 1e-6 * np.eye(5)
        want = [(aim(w + e) - aim(w - e)) / 2e-6 for e in step]
        assert np.allclose(toxicity.risk_gradient(w, p, u, prior), want, atol=1e-5)
    assert seen == {True, False}


def test_repeated_ids_have_one_fit(corpus):
    docs, labels = corpus
    again = docs.union(docs.filter("doc_id < 50").selectExpr("doc_id", "concat(text, ' more') as text"))
    one, two = (toxicity.fit(df, labels) for df in (again, again.repartition(7)))
    assert np.array_equal(one.keys, two.keys) and np.allclose(one.weights, two.weights, atol=1e-4)


def test_shares_learn_from_all_rows(corpus, monkeypatch):
    """Small shares choose the features that one share of all rows chooses, and tell as well what is toxic."""
    docs, labels = corpus
    whole = toxicity.fit(docs, labels)
    monkeypatch.setattr(toxicity, "POSITIVES", 20)
    monkeypatch.setattr(toxicity, "UNLABELLED", 150)
    model = toxicity.fit(docs, labels)
    assert np.array_equal(model.keys, whole.keys)
    rows = toxicity.score(docs.filter("doc_id < 900"), model).collect()
    assert sum((r.toxicity >= 0.5) == (r.doc_id % 8 == 0) for r in rows) / len(rows) > 0.97


def test_features_do_not_cross_texts():
    h, row = toxicity.features(pa.array(["abc", None, "", "abcdefghi abc"]))
    assert sorted(set(row.tolist())) == [0, 3]
    assert h[0] in h[row == 3]


def test_query(spark, sf_dir):
    rows = catalog.registered()["op1_nnpu_toxicity"](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.predicted == int(r.score >= 0.5) for r in rows)


def test_texts_are_not_shuffled_to_meet_their_labels(spark, corpus, monkeypatch):
    docs, labels = corpus
    plans, stage, before = [], toxicity.stage, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")

    def seen(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df, label)

    monkeypatch.setattr(toxicity, "stage", seen)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        model = toxicity.fit(docs, labels)
        assert "SortMergeJoin" not in plans[0]
        monkeypatch.setattr(toxicity, "BROADCAST_LABELS", 0)
        plans.clear()
        shuffled = toxicity.fit(docs, labels)
        assert "SortMergeJoin" in plans[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert (model.keys == shuffled.keys).all() and np.allclose(model.weights, shuffled.weights)
