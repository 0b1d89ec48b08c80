"""Tokens and decoded texts against the public library."""

from __future__ import annotations

import hashlib
import random
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerscope.llm.bpe import TOKENIZER, Encoder, encode, load_vocabulary, op8_bpe, prepare

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    found.no_truncation()
    found.no_padding()
    return found


def test_fuzzed_texts(library):
    rng = random.Random(4)
    encoder = Encoder(prepare(load_vocabulary(public_tokenizers.path(TOKENIZER))), cache=50)
    pool = "aΣσςİIıßẞǅ  ​ \u0085\x1c\n\t'S't'LL'VE’s<|endoftext|><|startoftext|><|x12½Ⅷé é ńñ한글ཨོཾ🏳️‍🌈ﬁǈ,.!!?"
    for _ in range(3000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 30)))
        if rng.random() < 0.3:
            text += rng.choice(["<|endoftext|>", " <|startoftext|>x", "<|ENDOFTEXT|>"])
        want = library.encode(text, add_special_tokens=False).ids
        packed, decoded = encoder.encode_decode(text)
        assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == want
        assert decoded == encoder.decode(want) == library.decode(want, skip_special_tokens=False)


def test_query(spark, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    got = op8_bpe(spark, SF_DIR).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_null_and_empty(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "Hello")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_tokens"], r["ids"]) for r in encode(docs).collect()}
    assert got[1] == got[2] == (0, [])
    assert got[3][0] == 1


def test_frequent_words_stay_and_encoding_keeps_no_strings():
    tables = prepare(load_vocabulary(public_tokenizers.path(TOKENIZER)))
    encoder, plain = Encoder(tables, cache=20, decodes=False), Encoder(tables, cache=20)
    for i in range(100):
        text = f"frequent w{i}x"
        packed, decoded = plain.encode_decode(text)
        assert encoder.encode(text) == packed and decoded == plain.decode(struct.unpack(f"<{len(packed) // 4}I", packed))
        for e in (encoder, plain):
            assert "frequent" in e.known or "frequent" in e.older
            assert len(e.known) <= 14 and len(e.older) <= 14
    assert {d for _, d in [*encoder.known.values(), *encoder.older.values()]} == {""}
