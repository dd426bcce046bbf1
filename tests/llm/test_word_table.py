"""The distinct-word table against the tokenizers library on whole texts."""
import hashlib
import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strata.llm import queries, word_table
from strata.llm.word_table import decode_documents, encode_documents, parts, split_words, word
from strata.sources.tables import read_table
from tests.conftest import SF_SMALL

BYTE = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(BYTE)
SIGNS = ["a", "b", "The", " ", "  ", "\n", " \n", "\n ", "\t", "\xa0", " ", "　", "\x85", "\x1c", "́", "\xe9", "'s", "12", "^", ".",
         "!!", "?", ",", "<|endoftext|>", "<|endof", "日本", "\U0001f600", "\0", " "]


def whole(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


def test_words_give_the_ids_of_the_whole_text():
    rnd = random.Random(5)
    for _ in range(2000):
        text = "".join(rnd.choices(SIGNS, k=rnd.randint(0, 30)))
        keys = [p for k in split_words(text.encode()) for p in parts(k)]
        assert "".join(map(word, keys)) == text
        assert [i for k in keys for i in whole(word(k))] == whole(text)


def test_slices_of_a_long_text(monkeypatch):
    monkeypatch.setattr(word_table, "SLICE_BYTES", 50)
    rnd = random.Random(6)
    for _ in range(200):
        text = "".join(rnd.choices([*SIGNS, " word and "], k=60))
        parts = list(word_table._slices(text.encode()))
        assert b"".join(parts).decode() == text
        assert [i for p in parts for k in split_words(p) for i in whole(word(k))] == whole(text)


def test_round_trip_of_odd_rows(spark):
    rnd = random.Random(7)
    texts = [None, "", " ", "x" * 300_000, "w " * 100_000, "same", "same", "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y"]
    texts += ["".join(rnd.choices(SIGNS, k=rnd.randint(0, 40))) for _ in range(200)]
    rows = [(None if k == 3 else k % 150, t, "clash", 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens long").repartition(3)
    found = decode_documents(encode_documents(docs, BYTE, chunk_bytes=2000), BYTE)
    got = sorted((r["doc_id"] is None, r["doc_id"], r["decoded"], r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist()) for r in found.collect())
    want = sorted((r[0] is None, r[0], r[1] or "", len(whole(r[1])), whole(r[1])) for r in rows)
    assert got == want
    both = encode_documents(docs, BYTE, chunk_bytes=2000, decoded_col="back")
    assert sorted((r["doc_id"] is None, r["doc_id"], r["back"]) for r in both.collect()) == [w[:3] for w in want]
    assert encode_documents(docs.where("false"), BYTE).count() == 0
    texts_as_ids = docs.select(F.col("text").alias("doc_id"), "text")
    assert encode_documents(texts_as_ids, BYTE).count() == len(rows)


def test_decoding_of_any_ids(spark):
    rnd = np.random.default_rng(1)
    lists = [rnd.integers(0, 50_300, 20).astype("<u4") for _ in range(100)]
    df = spark.createDataFrame([(k, bytearray(v.tobytes()), "clash") for k, v in enumerate(lists)] + [(-1, None, "x")],
                               "k int, ids binary, decoded string")
    got = {r["k"]: r["decoded"] for r in decode_documents(df, BYTE).collect()}
    assert got.pop(-1) == ""
    assert got == {k: PLAIN.decode([i for i in v.tolist() if i < 50_257], skip_special_tokens=False) for k, v in enumerate(lists)}


def test_query_on_documents(spark):
    got = {r["doc_id"]: r[1:] for r in queries.queries()["op13_word_table"](spark, SF_SMALL).collect()}
    docs = read_table(spark, SF_SMALL, "documents").collect()
    assert len(docs) == len(got)
    for r in docs:
        ids = whole(r["text"])
        assert got[r["doc_id"]] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                                    hashlib.sha256(PLAIN.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_packed_numbers():
    rng = np.random.default_rng(2)
    for top in (1, 239, 240, 241, 70_000, (16 << 16) - 1, 16 << 16, 3_000_000):
        numbers = np.append(rng.integers(0, top + 1, 500), [0, top]).astype(np.uint32)
        assert word_table._unpack_numbers(word_table._pack_numbers(numbers)).tolist() == numbers.tolist()
    assert word_table._unpack_numbers(word_table._pack_numbers(np.empty(0, np.uint32))).tolist() == []
