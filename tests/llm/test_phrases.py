"""Phrases against counts of every n-gram in plain Python."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tillroll.llm import phrases

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, phrase string, row long, n int"


def brute(rows, least, longest=5, top=2000):
    counts, totals = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(FOLD)):
            held = [x for x in re.split("[ \t]+", piece) if x]
            totals[lang] += len(held)
            for k in range(1, longest + 1):
                for i in range(len(held) - k + 1):
                    counts[lang, tuple(held[i : i + k])] += 1
    kept = {key: n for key, n in counts.items() if n >= least}
    covered = collections.defaultdict(int)
    for (lang, held), n in kept.items():
        for k in range(2, len(held)):
            for i in range(len(held) - k + 1):
                covered[lang, held[i : i + k]] = max(covered[lang, held[i : i + k]], n)
    out = collections.defaultdict(list)
    for (lang, held), a in kept.items():
        if len(held) < 2 or covered[lang, held] >= a:
            continue
        n = totals[lang]
        cuts = []
        for k in range(1, len(held)):
            left, right = kept[lang, held[:k]], kept[lang, held[k:]]
            cuts.append((1000 * a * n // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out[lang].append((-score, -a, " ".join(held).encode(), left, right, n))
    return sorted(
        (lang, rank, text.decode(), -a, left, right, n, -score)
        for lang, found in out.items()
        for rank, (score, a, text, left, right, n) in enumerate(sorted(found)[:top], 1)
    )


def _rows(df):
    return sorted(tuple(row) for row in df.collect())


def _table(spark, rows):
    return spark.createDataFrame([(i, text, lang, "x", 5, i) for i, (text, lang) in enumerate(rows)], SCHEMA)


def _texts(seed, count, longest):
    draw = random.Random(seed)
    vocabulary = ["a", "B", "b", "cé", "of", "the", "日本", "d-e", "f'", " ", "ß"]
    between = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "\r\n", "? "]
    text = lambda: "".join(draw.choice(vocabulary) + draw.choice(between) for _ in range(draw.randint(0, longest)))
    return [(text(), draw.choice(["en", "en", "fr", None, "", "und"])) for _ in range(count)]


ODD = [(None, "en"), ("", None), (" \t ", "en"), ("...", "en"), ("one", "zz"), ("a b " * 20_000, "en"),
       ("of the of the of the", "fr"), ("of the of the of the", "fr"), ("x" * 50_000 + " y", "en")]


@pytest.mark.parametrize("bits", [64, 12, 3])
def test_every_phrase(spark, bits):
    """Narrow fingerprints are shared by many phrases; the result is the same."""
    rows = _texts(bits, 150, 60) + ODD
    assert _rows(phrases.mine(_table(spark, rows), least=6, bits=bits)) == brute(rows, 6)


def test_top_and_ties(spark):
    rows = _texts(9, 80, 50)
    assert _rows(phrases.mine(_table(spark, rows), least=2, top=7)) == brute(rows, 2, top=7)
    assert _rows(phrases.mine(_table(spark, rows), least=5, longest=2)) == brute(rows, 5, longest=2)


def test_tally(monkeypatch):
    monkeypatch.setattr(phrases, "HELD", 50)
    tally = phrases.Tally({"n": "sum", "lo": "min"})
    draw, want, seen = random.Random(3), collections.Counter(), collections.Counter()

    def take():
        key, held = tally.taken()
        seen.update(dict(zip(key.tolist(), held["n"].tolist(), strict=True)))
        assert held["lo"].tolist() == key.tolist() == sorted(key.tolist())

    for _ in range(30):
        key = np.array([draw.randrange(200) for _ in range(40)], np.uint64)
        want.update(key.tolist())
        tally.add(key, n=np.ones(40, np.int64), lo=key.astype(np.int64))
        if tally.full():
            take()
    take()
    assert seen == want


@pytest.mark.parametrize("kind", [np.uint8, np.uint32, np.int64])
def test_planes(kind):
    values = np.array([0, 1, 200, 77], kind)
    assert phrases._unplaned(phrases._planes(values), kind).tolist() == values.tolist()
    assert len(phrases._unplaned(phrases._planes(values[:0]), kind)) == 0


def test_a_pointer_to_another_phrase_is_noticed(spark):
    held = phrases.Grams(pa.array(["of the"]), pa.array(["en"]), check=True)
    at = held.at(2)
    fp, lo = int(held.keys(at, 2).view(np.int64)[0]), int(held.checks(at, 2)[0])
    schema = "lang string, k int, phrase string, fp long, lo long, n long"
    good = spark.createDataFrame([("en", 2, "of the", fp, lo, 3)], schema)
    assert phrases.verified(good, 64).count() == 1
    for row in [("en", 2, "of that", fp, lo, 3), ("fr", 2, "of the", fp, lo, 3), ("en", 2, "of the", fp, lo + 1, 3)]:
        with pytest.raises(Exception, match="other fingerprints"):
            phrases.verified(spark.createDataFrame([row], schema), 64).count()


def test_products_beyond_64_bits(spark):
    big = 10**13
    held = spark.createDataFrame(
        [("en", 1, "x", big + 7), ("en", 1, "y", big + 9), ("en", 2, "x y", big - 3)], "lang string, k int, phrase string, a long"
    )
    totals = spark.createDataFrame([("en", 77 * big)], "lang string, n long")
    row = phrases.collocations(held, totals).first()
    assert row["score"] == 1000 * (big - 3) * 77 * big // ((big + 7) * (big + 9))


def test_no_words(spark):
    assert phrases.mine(_table(spark, [(None, "en"), (" ", None)])).collect() == []
    assert phrases.mine(_table(spark, [("a", "en")]).filter("doc_id < 0")).collect() == []


def test_bitmaps_travel_slim():
    for share in (0.0, 1e-6, 0.5):
        bits = np.random.default_rng(1).random(phrases.FILTER_BITS) < share
        held = np.packbits(bits, bitorder="little")
        slim = phrases._slim(held)
        assert slim.nbytes <= held.nbytes and np.array_equal(phrases._opened(slim), held)
