from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from samples import prose


@pytest.fixture
def make(spark):
    """``make(rows)``: documents with every column, and extra ones with clashing names."""
    from corpusloom.llm.shipping import ship

    ship(spark)

    def build(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        df = df.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").otherwise("bb"))
        df = df.withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))
        for name in ("key", "id", "size", "block", "order", "guest", "slot", "vslot", "bands", "n", "place",
                     "sketch", "g", "found", "item_id", "host", "part"):
            df = df.withColumn(name, F.lit(name))
        return df

    return build


@pytest.fixture(scope="session")
def corpus():
    """Texts with exact and near copies, shared passages, a chain of edits and short texts."""
    rng = random.Random(5)
    texts = [prose(i, rng.choice([3, 20, 60, 150, 400])) for i in range(60)]
    base = prose(1000, 120)
    for i in range(40):  # near copies of all degrees
        own = list(base)
        for _ in range(rng.randrange(0, 12)):
            own[rng.randrange(len(own))] = f"e{rng.randrange(999)}"
        texts.append(own)
    passage = prose(2000, 50)
    for i in range(12):
        texts.append(prose(3000 + i, 30) + passage + prose(4000 + i, 10 + i))
    texts += [list(texts[3]), list(texts[4]), list(texts[70])]
    texts.append(passage[:34])
    texts.append(passage[5:40] * 2)
    return [(i + 1, (" " if i % 3 else "\n").join(t)) for i, t in enumerate(texts)]
