"""Tree concatenation against the library's own encoding."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tillroll.llm import bpe, catalog, tree

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "\n\n  a", "a  b", "don't I'll", "x" * 5000, "é" * 300, "日本語テキスト、🙂🙂" * 40, "1 234  5\t\t6 ",
    "\x1c a\x1d b", "a b c \u0085 d", " lead", "same", "same", "<|endoftext|> x<|endoftext|><|endoftext", "ab" * 999,
    "a  b 　 c  d  e  f", " " * 700 + "x", "<|endoftext|>" * 30 + "y" * 400, "tab\tx \n y",
    "".join(chr(0x4E00 + i % 700) for i in range(3000)), "a" * 1023 + " " + "a" * 1025, "=" * 2049, "'s" * 200,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def _ids(row):
    return np.frombuffer(bytes(row.ids), "<u4").tolist()


@pytest.mark.parametrize("leaf", [3, 16, tree.LEAF])
def test_ids_and_round_trip(make_docs, library, leaf):
    rows = tree.decode(tree.encode(make_docs(ODD), PATH, leaf=leaf), PATH).collect()
    assert len(rows) == len(ODD)
    for row in rows:
        want = library.encode(ODD[row.doc_id] or "", add_special_tokens=False).ids
        assert _ids(row) == want
        assert row.decoded == library.decode(want, skip_special_tokens=False) == (ODD[row.doc_id] or "")
        assert row.score == 7  # a column of the user's


def test_query_against_the_library(spark, sf_dir, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = catalog.registered()["op13_tree_bpe"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for row in rows:
        ids = library.encode(docs[row.doc_id], add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        text = library.decode(ids, skip_special_tokens=False)
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_unsplit_units_of_random_letters(library):
    """Units that merge freely, with runs and periods that push agreement far from the join."""
    v, draw = tree.vocabulary(PATH), random.Random(1)
    units = []
    for _ in range(400):
        letters = draw.choice(["ab", "aeinrst", "abcdefghijklmnopqrstuvwxyz", "Ġt", "the", "0", "=-"])
        n = draw.choice([1, 7, 63, 64, 65, 500, 1500])
        period = draw.choice([0, 0, 3, 17])
        text = "".join(draw.choice(letters) for _ in range(period or n))
        units.append((text * n)[:n])
    for leaf in (2, 9, 64):
        assert tree.concatenated(v, units, leaf) == v.merged(units)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60), st.integers(1, 9))
def test_any_text(text, leaf):
    library = tree.vocabulary(PATH).tokenizer
    pieces = tree.Pieces(tree.vocabulary(PATH), leaf)
    data = np.frombuffer(text.encode(), np.uint8)
    ids, bounds = pieces.encode(data, np.array([0, len(data)]))
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert bounds.tolist() == [0, len(ids)]


def test_pieces_of_one_hash(monkeypatch, library):
    monkeypatch.setattr(tree, "span_hash", lambda sums, starts, ends: (ends - starts).astype(np.uint64))
    text = "one two six ten one"
    data = np.frombuffer(text.encode(), np.uint8)
    ids, _ = tree.Pieces(tree.vocabulary(PATH), 64).encode(data, np.array([0, len(data)]))
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_ids_that_are_no_text(spark, library):
    """Ids of halves of characters decode with the mark for unreadable bytes, as the library does."""
    ids = library.encode("日本🙂", add_special_tokens=False).ids
    rows = [(i, bytes(np.array(ids[i:j], "<u4"))) for i in range(len(ids)) for j in range(i, len(ids) + 1)]
    held = tree.decode(spark.createDataFrame([*rows, (-1, None)], "n int, ids binary"), PATH).collect()
    for row in held:
        want = library.decode(_ids(row), skip_special_tokens=False) if row.ids else ""
        assert row.decoded == want


def test_empty_table_and_clashing_name(make_docs, spark):
    assert tree.digest(make_docs([None]).filter("doc_id < 0"), PATH).count() == 0
    with pytest.raises(ValueError, match="ids"):
        tree.encode(spark.createDataFrame([("a", 1)], "text string, ids int"), PATH)
    assert bpe.byte_alphabet()[0x20] == "Ġ"
