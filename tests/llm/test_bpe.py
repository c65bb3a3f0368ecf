"""Encoding against the tokenizer library's own reading of the same vocabulary."""

import random

import pytest

from pelorus.llm.bpe import WordIds, encode_corpus, merge_long, merge_short, parse_ranks
from pelorus.llm.queries import TOKENIZERS, WORDS

regex = pytest.importorskip("regex")
PATH = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def ranks():
    try:
        with open(PATH, "rb") as file:
            return parse_ranks(file.read())
    except OSError:
        pytest.skip("no vocabulary here")


@pytest.fixture(scope="module")
def peer():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def texts():
    rng = random.Random(5)
    alphabet = "abcdeghilnorstuABC 019.,'\"-\n\t  \r\x1c\x1f\x85 ​　éßñœжя中文字日本한글🌦️👨‍🌾ﷺ́﻿{}[]<|>"
    yield from ("", " ", "\n\n  x", "<|endoftext|> next <|startoftext|>", "I'll we've 'S can't", "a" * 700, "é" * 300, "\x1c\x1d a\x1e", "ab" * 2000, " " * 300 + "x")
    for n in range(400):
        yield "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 80)))


def test_ids_equal_the_library(ranks, peer):
    cache, words = WordIds(ranks), regex.compile(WORDS).findall
    for text in texts():
        assert [i for w in words(text) for i in cache[w]] == peer.encode(text, add_special_tokens=False).ids, text


def test_long_and_short_merges_agree(ranks):
    rng = random.Random(6)
    for _ in range(300):
        word = bytes(rng.choice(b"aeiontsr th\xc3\xa9") for _ in range(rng.randrange(1, 400)))
        assert merge_short(word, ranks) == merge_long(word, ranks)


def test_every_row_has_a_list(spark, ranks):
    rows = [(1, "snow on the hill", "x"), (2, "", "x"), (3, None, "x"), (1, "snow on the hill", "x"), (4, "w" * 100_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = encode_corpus(df, id_col="doc_id", text_col="text", ranks_path=PATH, pattern=WORDS).collect()
    by = {r.doc_id: r.ids for r in got}
    assert len(got) == 5 and by[2] == [] and by[3] == [] and by[1]
    inverse = {i: t for t, i in ranks.items()}
    assert b"".join(inverse[i] for i in by[4]) == b"w" * 100_000
    empty = encode_corpus(df.limit(0), id_col="doc_id", text_col="text", ranks_path=PATH, pattern=WORDS)
    assert empty.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")] and empty.count() == 0
