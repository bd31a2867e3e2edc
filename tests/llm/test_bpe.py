"""Byte pair encoding against the tokenizers library."""

import hashlib
import json
import random

import public_tokenizers
import pytest
import tokenizers

from lodestead.llm import bpe, tokencount
from lodestead.llm.queries import QUERIES

NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
RANDOM = random.Random(5)
TEXTS = [
    None, "", "   ", "a", "Σας ΣΑΣ", "İstanbul é \x1c a\x1cb <|endoftext|>x<|startoftext|>", "don't I'LL 're 12 34a5 ½ ² Ⅷ", "日本語 😀👍🏽",
    "a" * 5000, "ab" * 3000, "\x85a\xa0b　c d   e f", " \n\n a  b\t\tc  ", "word " * 30000, "<|endoftext|><|endoftext|> z",
    "".join(RANDOM.choice("thein") for _ in range(20000)), "".join(RANDOM.choice("abcdeinthr ,.\n") for _ in range(5000)),
]


@pytest.fixture(scope="module", params=NAMES)
def pair(request):
    path = public_tokenizers.path(request.param)
    with open(path, encoding="utf-8") as file:
        return bpe.Bpe(json.load(file)), tokenizers.Tokenizer.from_file(path)


def test_ids_and_text(pair):
    mine, library = pair
    for text in TEXTS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert list(mine.ids(text or "")) == ids
        assert "".join(mine.decode(ids)) == decoded
        assert mine.digest(text or "") == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_windows_give_what_the_whole_gives(pair):
    mine, _ = pair
    for n in (1, 10, 400, 3000):
        for letters in ("a", "th", "thein", "abcdeinthr"):
            symbols = list(mine.symbols("".join(RANDOM.choice(letters) for _ in range(n))))
            assert list(mine.stream(symbols, stride=3)) == mine.merge_window(symbols)[0]
    assert mine.lookahead < 1000


def test_many_at_once(pair):
    mine, _ = pair
    words = list({"".join(RANDOM.choice("aathein") for _ in range(RANDOM.randrange(1, 14))) for _ in range(500)} | {"aaaaaaa"})
    assert mine.merge_many(words) == [mine.merge_short(list(mine.symbols(w))) for w in words]


def test_byte_decoder_is_incremental(pair):
    mine, _ = pair
    if mine.byte_decoder:
        pieces = list(mine.decode(mine.ids("😀 é")))
        assert "".join(pieces) == "😀 é" and all("�" not in p for p in pieces)
        assert "".join(mine.decode(list(mine.ids("😀"))[:1])) == "�"


def test_frames(spark):
    rows = [(i, t, "x", 7.5) for i, t in enumerate(TEXTS)] + [(3, "a", "x", 1.0), (None, "a", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids double")
    path = public_tokenizers.path(NAMES[0])
    library = tokenizers.Tokenizer.from_file(path)
    found = bpe.decode(bpe.encode(docs, path), path).collect()
    assert len(found) == len(rows)
    for r in found:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False) and r.n_tokens in ("x", None)
    assert bpe.digests(docs, path).count() == len(rows)
    assert bpe.digests(docs.limit(0), path).count() == 0


def test_token_counts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    texts = [*TEXTS, "foo   bar\xa0 baz\xa0", "　 　x", "x\n\n\n", "<|endoftext|"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] * 2, "doc_id long, text string, block int").repartition(3)
    found = tokencount.count(docs, path).collect()
    assert len(found) == 2 * len(texts)
    for r in found:
        text = texts[r.doc_id] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 512), repr(text[:40])
    assert tokencount.count(docs.limit(0), path).count() == 0


def test_queries_against_the_library(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    word, byte = (tokenizers.Tokenizer.from_file(public_tokenizers.path(n)) for n in NAMES)
    for r in QUERIES["op1_bpe"](spark, sf).collect():
        ids = word.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(word.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    counts = {r.doc_id: r.n_tokens for r in QUERIES["op6_token_counts"](spark, sf).collect()}
    assert counts == {i: len(byte.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}
