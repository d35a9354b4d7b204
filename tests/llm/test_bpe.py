import hashlib
import random

import pytest

from citelake.llm import bpe


@pytest.fixture(scope="module")
def tools():
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.no_padding()
    own.no_truncation()
    return bpe.Encoder(bpe.vocabulary_bytes(), chunk_bits=4), own


def same(tools, text):
    encoder, own = tools
    ids = own.encode(text, add_special_tokens=False).ids
    assert encoder.encode(text) == ids
    assert encoder.decode(ids) == own.decode(ids, skip_special_tokens=False)


def test_every_code_point(tools):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    encoder, own = tools
    texts = ["".join(f"x{c} {c}y {c} " for c in points[i : i + 100]) for i in range(0, len(points), 100)]
    for text, e in zip(texts, own.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encoder.encode(text) == e.ids


def test_random_texts_and_reuse(tools):
    random.seed(3)
    letters = [" ", " ", " ", "\n", "\t", "a", "b", "the", " of", "'", "s", "é", "1", "22", "!", "<|endoftext|>", "　", "​", "\x85", "\xa0", "😀", "中"]
    for _ in range(1500):
        same(tools, "".join(random.choice(letters) for _ in range(random.randint(0, 120))))
    base = " ".join(f"word{i % 37} and{i}" for i in range(3000))
    same(tools, base)
    tools[0].asked = tools[0].reused = 0
    same(tools, "Other start. " + base[:9000] + " changed " + base[9000:])
    assert tools[0].reused > 0.9 * tools[0].asked


def test_long_without_spaces(tools):
    same(tools, "a" * 5000 + "é" * 3000 + " " * 2000 + "b")


def test_any_text_is_encoded_whole(tools):
    for text in (" " * 1_200_000, "x " + " " * 1_200_000 + " y end", "word" * 100_000, "\n" * 300_000 + "a b", "<|endoftext|>" * 20_000):
        same(tools, text)


def test_short_copies_are_reused(tools):
    encoder, _ = tools
    encoder.asked = encoder.reused = 0
    for _ in range(10):
        same(tools, "tiny")
    assert encoder.reused >= 0.9 * encoder.asked - 1


def test_table(spark, tools):
    rows = [(1, "Hello world", 9), (2, None, 9), (3, "", 9), (3, "", 9), (None, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = {r["doc_id"]: r for r in bpe.bpe(df, bpe.vocabulary_bytes()).collect()}
    assert got[1]["decoded"] == "Hello world" and got[2]["ids"] == [] and got[3]["decoded"] == "" and got[None]["ids"]
    assert bpe.bpe(df.limit(0), bpe.vocabulary_bytes()).count() == 0


def test_query(spark, tools):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in bpe.query(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = tools[1].encode(d["text"] or "", add_special_tokens=False).ids
        assert got[d["doc_id"]]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[d["doc_id"]]["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()
