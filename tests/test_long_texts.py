"""Texts spread over tasks give what the folds in a row give."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from test_folds import ODD, random_text

from corpusloom.functions import text
from corpusloom.operators import clauses, long_texts, semantic_chunks
from corpusloom.operators.semantic_chunks import SENTENCE_BREAK

SCHEMA = "doc_id long, full_text string, text string, n int, block string"


@pytest.fixture(scope="module")
def own(spark):
    rng = random.Random(8)
    texts = [*ODD, *[random_text(rng) * rng.randrange(1, 5) for _ in range(40)], None, "a b c d e f g h " * 30,
             "word" * 80, "Para one.\n\n\n\nTwo! \"Quoted\"\n\n" * 30, "x" * 400 + "\n\n" + "y" * 9]
    return spark.createDataFrame([(i, t, "t", 1, "b") for i, t in enumerate(texts)], SCHEMA)


@pytest.mark.parametrize("size", [7, 40, 1 << 20])
def test_cuts_never_touch_white_space(own, size):
    for r in own.where("full_text is not null").collect():
        starts = long_texts.cut_places(r.full_text, size)
        assert starts[0] == 0 and starts == sorted(set(starts))
        assert not any(c in text.WHITESPACE for s in starts[1:] for c in r.full_text[s - 1:s + 1])


@pytest.mark.parametrize("size", [7, 40, 1 << 20])
def test_spread_sentences_equal_the_fold(own, rows, size):
    want = semantic_chunks.sentences(own).select("doc_id", "ord", "char_start", "char_end", "text")
    got = long_texts.sentences(own, SENTENCE_BREAK, size=size)
    assert rows(got) == rows(want) and got.count() > 100


@pytest.mark.parametrize("size,limit", [(7, 3), (40, 12), (40, 3000), (1 << 20, 12)])
def test_spread_windows_equal_the_fold(own, rows, size, limit):
    cols = ["doc_id", "n", "w", "char_start", "char_end", "text"]
    want = clauses.windows(own, max_window_tokens=limit, keep=["n"]).select(cols)
    assert rows(long_texts.windows(own, max_window_tokens=limit, keep=["n"], size=size).select(cols)) == rows(want)


def test_one_long_document_is_many_tasks_work(spark):
    body = "A sentence of some words. " * 40 + "\n\n"
    df = spark.createDataFrame([(1, body * 300)], "doc_id long, full_text string")
    cut = long_texts.blocks(df, size=10_000)
    sizes = [r["count"] for r in cut.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) > 25 and len(sizes) > 2 and max(sizes) < sum(sizes) * 0.6
    found = long_texts.sentences(df, SENTENCE_BREAK, size=10_000)
    assert found.agg(F.count("*"), F.max("ord"), F.max("char_end")).first() == (12_000, 12_000, len(body) * 300 - 2)
