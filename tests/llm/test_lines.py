import random

import brute
import pytest

from tillroll.llm import catalog, lines


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    families = [[word() for _ in range(80)] for _ in range(12)]
    texts = [None, "", "\n\n", "ab", "ab\nab\r\n ab ", "日本語の文章です。" * 20, "日本語の文章です。" * 20 + "追加"]
    for _ in range(80):
        held = []
        for _ in range(rng.randrange(1, 8)):
            line = list(rng.choice(families)) if rng.random() < 0.4 else [word() for _ in range(rng.randrange(1, 30))]
            if rng.random() < 0.5:
                line[rng.randrange(len(line))] = word()
            held.append(" ".join(line))
        texts.append("\n".join(held))
    return texts


def test_against_all_pairs(make_docs):
    texts = corpus(1)
    rows = lines.remove(make_docs(texts)).collect()
    assert {r.doc_id: r.text for r in rows} == brute.line_dedup(dict(enumerate(texts)))
    assert {r.score for r in rows} == {7}


def test_shuffled_ids_and_no_broadcast(make_docs, monkeypatch):
    monkeypatch.setattr(lines, "BROADCAST_ROWS", 0)
    texts = corpus(2)
    assert {r.doc_id: r.text for r in lines.remove(make_docs(texts)).collect()} == brute.line_dedup(
        dict(enumerate(texts))
    )


def test_shingles(spark):
    values = ["abc", "abcdefgh", "aaa aaaaaa aaaa, a", "añ\tb c  d e f1234 gh", "日本語の文章です。" * 5 + "日本語", "日本語の文章です。日本語", "x" * 500 + " y" * 20, "🙂" * 12 + " 🙂b", "a  b   cdefghijkl  m"]
    rows = spark.createDataFrame([(v,) for v in values], "s string").select(lines.shingles(lines.F.col("s")).alias("g"))
    assert [frozenset(r.g) for r in rows.collect()] == [brute.line_shingles(v) for v in values]


def test_one_rule_for_lines_of_any_length(spark):
    """One more character changes few shingles, whatever the length of the words."""
    for line in ("x" * 0 + "abcdefghijklmnopqrstuvwx yzabcdefghijklmnopqrstuvw", "abcdefghijklmnopqrstuvwxyz0123456789" * 2):
        rows = spark.createDataFrame([(line,), (line + "!",)], "s string").select(lines.shingles(lines.F.col("s")).alias("g"))
        x, y = (set(r.g) for r in rows.collect())
        assert len(x & y) / len(x | y) > 0.9


def test_query(spark, sf_dir):
    """Nearly all that comparing all lines removes is found; nothing else is removed."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in catalog.registered()["op8_minhash_lines"](spark, sf_dir).collect()}
    expected = brute.line_dedup(texts)
    assert set(rows) == set(texts)
    left = lambda t: t.split("\n") if t else []
    # A link is found with the chance that its lines share a bucket; what is removed is linked.
    removed = lambda t, full: len(left(full)) - len(left(t))
    wanted = sum(removed(expected[i], texts[i]) for i in texts)
    found = sum(removed(rows[i].text, texts[i]) for i in texts)
    assert 0.986 * wanted <= found <= wanted
    assert all(r.n_lines - r.n_removed == len(left(r.text)) or not r.text for r in rows.values())


def test_empty_and_repeated_rows(make_docs):
    docs = make_docs(["same line here\nother words there", "same line here"])
    assert lines.remove(docs.limit(0)).count() == 0
    rows = lines.remove(docs.union(docs)).collect()
    assert sorted((r.doc_id, r.text) for r in rows) == [(0, "same line here\nother words there")] * 2 + [(1, "")] * 2


def test_bands_find_short_lines(spark):
    """Pairs at a Jaccard similarity of 0.8 with 8 or 16 shared shingles share a bucket with the chance that is stated."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(8))
    for shared, own in ((8, 1), (16, 2)):
        rows = []
        for pair in range(1500):
            common = [word() for _ in range(shared)]
            rows += [(2 * pair + side, " ".join(common + [word() for _ in range(own)])) for side in (0, 1)]
        held = lines._signatures(spark.createDataFrame(rows, "line long, chars string")).collect()
        minima = {r.line: [r[f"m{i}"] for i in range(lines.BANDS * lines.ROWS)] for r in held}
        bands = lambda m: {(b, *m[b : b + lines.ROWS]) for b in range(0, len(m), lines.ROWS)}
        met = sum(bool(bands(minima[2 * p]) & bands(minima[2 * p + 1])) for p in range(1500))
        assert met >= 0.975 * 1500


def test_every_character_counts(make_docs):
    """Lines that differ only after the eighth character of a word all stay; full character shingles say the same."""
    held = [
        "Source: https://example.com/page1", "Source: https://other.org/z9", "2024-01-05T10:00", "2024-01-31T23:59",
        "Introduction", "Introductory", "identifier-0001-abcd", "identifier-9734-wxyz", "see identifier-55aa77 there",
        "see identifier-90bb12 there",
    ]
    full = [{x[i : i + 8] for i in range(max(1, len(x) - 7))} for x in held]
    assert all(5 * len(x & y) < 4 * len(x | y) for i, x in enumerate(full) for y in full[:i])
    assert [r.text for r in lines.remove(make_docs(["\n".join(held)])).collect()] == ["\n".join(held)]
    values = [*held, "short words only", "x" * 9, "x" * 12 + " " + "y" * 13, "añ 日本語の文章です。日本語"]
    rows = make_docs(values).select("text", lines.shingles(lines.F.col("text")).alias("g")).collect()
    for r in rows:
        places = {r.text.find(g.rstrip()) + i for g in r.g for i in range(len(g.rstrip()))}
        assert {i for i, c in enumerate(r.text) if c != " "} <= places or len(set(r.text)) < 5
        assert frozenset(r.g) == brute.line_shingles(r.text)


def test_template_families(make_docs):
    """Pairs of lines on one frame (0.85 within a pair, 0.66 to the others), where hardly a bucket's smallest line helps."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(8))
    frame, texts = [word() for _ in range(19)], []
    for _ in range(300):
        own = [word() for _ in range(3)]
        texts += [" ".join([*frame, *own, word(), word()]) for _ in range(2)]
    rng.shuffle(texts)
    expected = brute.line_dedup(dict(enumerate(texts)))
    gone = {i for i, t in expected.items() if not t}
    assert len(gone) == 300
    found = {r.doc_id for r in lines.remove(make_docs(texts)).collect() if not r.text}
    assert found <= gone and len(found) >= 0.97 * len(gone)


def test_clashing_names_nulls_and_long_lines(spark):
    """Columns named like the helpers of the operator stay as they are; null ids and texts, very long lines."""
    long = " ".join(f"word{i}" for i in range(20_000))
    rows = [
        (None, "a line without an id", 1, 2, 3, "x"), (2, None, 1, 2, 3, "y"), (3, long + "\n" + "z" * 60_000, 1, 2, 3, "z"),
        (4, long + " more\nshort", 1, 2, 3, None), (None, "a line without an id", 1, 2, 3, "x"), (6, "short\n\n\r", 9, 8, 7, "w"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __doc int, places int, line int, `a.b` string")
    got = {(r["doc_id"], r["a.b"]): tuple(r) for r in lines.remove(docs).collect()}
    assert got[3, "z"] == rows[2] and got[2, "y"] == rows[1]
    assert got[4, None] == (4, "short", 1, 2, 3, None) and got[6, "w"] == (6, "\n\r", 9, 8, 7, "w")
    assert got[None, "x"] == rows[0]
    with pytest.raises(ValueError, match="n_lines"):
        lines.remove(docs.withColumn("n_lines", lines.F.lit(1)), report=True)


def test_large_buckets_are_dealt_to_tiles(make_docs, monkeypatch):
    monkeypatch.setattr(lines, "TILE", 2)
    texts = corpus(3)
    assert {r.doc_id: r.text for r in lines.remove(make_docs(texts)).collect()} == brute.line_dedup(
        dict(enumerate(texts))
    )
