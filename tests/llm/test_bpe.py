import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken

from tillroll.llm import bpe, catalog

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [
    None, "", " ", "\n\n  a", "a  b", "don't I'll", "x" * 5000, "é" * 300, "日本語 テキスト 🙂🙂", "1 234  5\t\t6 ",
    "\x1c a\x1d b", "a b c \u0085 d", " lead", "same", "same", "<|endoftext|> x", "tab\tx \n y",
]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_offsets_and_round_trip(make_docs, reference):
    rows = bpe.decode(bpe.encode(make_docs(ODD), PATH), PATH).collect()
    assert len(rows) == len(ODD)
    for row in rows:
        text = ODD[row.doc_id] or ""
        assert row.ids == reference.encode_ordinary(text)
        assert bytes(row.decoded) == text.encode()
        parts = [reference.decode_single_token_bytes(i) for i in row.ids]
        at = 0
        for start, end, part in zip(row.starts, row.ends, parts, strict=True):
            inside = text.encode()[at : at + len(part)]
            assert inside == part and inside in text[start:end].encode()
            at += len(part)


def test_query_against_the_other_library(spark, sf_dir, reference):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = catalog.registered()["op4_byte_bpe"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for row in rows:
        ids = reference.encode_ordinary(docs[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(docs[row.doc_id].encode()).hexdigest()


def test_empty_table(make_docs):
    assert bpe.digest(make_docs([None]).filter("doc_id < 0"), PATH).count() == 0


def test_pieces_met_again_are_encoded_once(reference, monkeypatch):
    """However many rare pieces pass by, common ones are not encoded anew, and ids stay those of the whole text."""
    tokenizer, _, bounds = bpe.vocabulary(PATH)
    asked = []

    class Counting:
        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return tokenizer.encode_batch_fast(texts, **options)

    monkeypatch.setattr(bpe, "PIECES_KEPT", 50)
    pieces = bpe._Pieces(Counting(), bounds[1:] - bounds[:-1])
    for turn in range(20):
        rare = " ".join(f"rare{turn}x{i}, é{i}\nß{turn}" for i in range(40))
        texts = ["a common phrase, a common phrase, too", rare, *(x or "" for x in ODD), "", "x  y z  w a\x1c b c"]
        ids, begins = pieces.encode(texts)
        held = [ids[a:b].tolist() for a, b in zip(begins[:-1], begins[1:], strict=True)]
        assert held == [reference.encode_ordinary(x) for x in texts]
    assert sum(x.count(" phrase,") for x in asked) == 1
    # different pieces of one call are few texts
    assert sum("rare7x" in x for x in asked) <= 2
