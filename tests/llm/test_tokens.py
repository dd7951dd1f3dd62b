"""SentencePiece encoding, decoding and counting against the library."""

import hashlib
import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from wattline.llm.counting import CHUNK, Transducer, compose, count_tokens
from wattline.llm.encoding import encode, encode_text, known_words, model_path
from wattline.llm.pieces import pieces

from .conftest import SMALL


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=model_path())


def random_texts():
    rng = random.Random(3)
    letters = "abcdefghi theTHE▁▁  \n\t\x00é😀ก梦中文́ing'’—0123456789"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    return [*texts, "", " ", "   ", "▁", " " * 700, "ab" * 900, "the" * 400, "x" * (CHUNK - 1), "y " * CHUNK, "</s><unk>"]


def test_words_encode_and_decode_like_the_library(library):
    known = known_words(model_path())
    for text in random_texts():
        ids, back = encode_text(text, known)
        want = library.encode(text)
        assert [int(i) for i in ids.split(" ")] == [*want, library.eos_id()], text
        assert back == library.decode(want), text


def test_transducer_counts_like_the_library(library):
    texts = random_texts()
    assert Transducer(pieces(model_path())).counts(texts).tolist() == [len(x) for x in library.encode(texts)]


def test_chunk_maps_compose_by_doubling():
    import numpy as np

    owner = np.array([0] * 5 + [1] + [2] * 4)
    start, end = np.arange(10), np.arange(1, 11)
    s, e, c = compose(owner, start, end, np.ones(10, int))
    assert c.tolist() == [1, 2, 3, 4, 5, 1, 1, 2, 3, 4] and s.tolist() == [0] * 5 + [5] + [6] * 4 and e.tolist() == end.tolist()


def test_odd_rows(odd_docs, odd_rows, library):
    clash = odd_docs.withColumn("n_tokens", F.lit("kept out")).withColumn("extra", F.lit(1))
    got = count_tokens(clash, model_path(), limit=100).collect()
    assert len(got) == len(odd_rows) and set(got[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars", "extra", "n_bytes", "n_tokens", "over_limit"}
    for r in got:
        n = len(library.encode(r.text or ""))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((r.text or "").encode()), n > 100)
    for r in encode(clash, model_path(), decoded_col="back", digests=True).collect():
        ids = [*library.encode(r.text or ""), library.eos_id()]
        assert r.ids == ids and r.n_tokens == len(ids) and r.back == library.decode(ids) and r.extra == 1
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.back.encode()).hexdigest()


def test_empty_table(no_docs):
    assert count_tokens(no_docs, model_path()).count() == 0 and encode(no_docs, model_path()).count() == 0


def test_queries_against_the_library(spark, library):
    from wattline.llm.catalog import QUERIES

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in QUERIES["op3_transducer_counts"](spark, SMALL).collect():
        assert r.n_tokens == len(library.encode(texts[r.doc_id]))
    rows = QUERIES["op7_sentencepiece_codec"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = [*library.encode(texts[r.doc_id]), library.eos_id()]
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
