import random

import pytest

from codeweft.llm import tokens

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


CASES = ["", " ", "\n\n  x", "a" * 3000, " " * 700, "naïve café – “x”", "日本語のテキスト", "<|endoftext|> 1", "​﻿\xa0", "👩‍🔧", "I'll don't 'S", "\x00\x1c\x1d\x85 a", "tab\t\tx \r\n\r\n", "===----====" * 50]


@pytest.mark.parametrize("text", CASES)
def test_equals_library(reference, text):
    bpe = tokens.codec()
    assert bpe.encode(text) == reference(text)
    assert bpe.decode(bpe.encode(text)) == text


def test_random_strings(reference):
    bpe, rng = tokens.codec(), random.Random(5)
    for _ in range(400):
        text = "".join(rng.choice("abcdeginrst  \n.,;(){}_=ABCéß中я1029'\"") for _ in range(rng.randrange(1, 120)))
        assert bpe.encode(text) == reference(text)


def test_null_empty_repeated_clashing(spark):
    df = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (2, "", "k"), (3, "a b", None)], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in tokens.encode_column(df, "doc_id", "text").collect())
    assert got[:3] == [(1, []), (2, []), (2, [])] and len(got[3][1]) == 2
    assert tokens.encode_column(df.where("false"), "doc_id", "text").count() == 0
