import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from siftwell.llm import bpe
from siftwell.llm.queries import QUERIES


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).prepare()


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(codec.vocab)}, special_tokens={})


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_perfect_hash_is_minimal(codec):
    assert sorted(codec.hashed.slots) == list(range(len(codec.vocab)))
    assert all(codec.vocab[codec.hashed.slot(t)] == t for t in codec.vocab)


def test_same_as_library(codec, library):
    rnd = random.Random(5)
    parts = ["a", "Ab", " ", "  ", "\n", "\t", "'s", "'", "1", "é", "\x1c", "😀", "漢", "!", "\r\n", "the", "'LL", "\x85", "½", "Ⅷ", "٣", ".", ","]
    for _ in range(5000):
        s = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        assert ids(codec.encode(s)) == library.encode_ordinary(s), s


def test_long_word(codec, library):
    s = "ab" * 20000 + "é" * 999
    assert ids(codec.encode(s)) == library.encode_ordinary(s)


def test_round_trip_with_nulls_and_clashes(spark, codec):
    df = spark.createDataFrame([(1, "x y  z\n", "k"), (2, None, "k"), (3, "", None), (3, "", None)], "doc_id long, text string, IDS string")
    enc = bpe.encode(df, codec)
    out = bpe.decode(enc, codec).collect()
    assert [f for f in enc.columns] == ["doc_id", "text", "ids"]
    assert [bytes(r.decoded).decode() for r in sorted(out, key=lambda r: r.doc_id)] == ["x y  z\n", "", "", ""]
    assert bpe.encode(df.limit(0), codec).count() == 0
    assert bpe.encode(df, codec, array=True).where("doc_id = 1").first().ids == ids(codec.encode("x y  z\n"))


def test_query_against_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op2_byte_bpe"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        own = np.array(library.encode_ordinary(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(own), hashlib.sha256(own.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
