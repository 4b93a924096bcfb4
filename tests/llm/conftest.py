import random
import re

import pytest
from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators use themselves
    T.StructField("row", T.IntegerType()), T.StructField("score", T.StringType()), T.StructField("size", T.StringType()),
    T.StructField("kept", T.StringType()), T.StructField("h", T.StringType()), T.StructField("node", T.StringType()),
])


def make(spark, rows):
    """Documents from (doc_id, text, lang, source), with columns whose names clash."""
    return spark.createDataFrame([(i, t, la, s, len(t or ""), 1, "x", "x", "x", "x", "x") for i, t, la, s in rows], SCHEMA)


def sentence(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Null, empty, blank, short and very long texts, copies, near copies, repeated rows, null ids and sources."""
    rng = random.Random(3)
    words = ["the", "of", "and", "to"] + [f"w{i}" for i in range(400)]
    out = [(1, None, "en", "a"), (2, "", "en", None), (3, " \t\n\v\f\r ", None, "b"), (4, "one", "en", "a"), (5, "One", "en", "b"),
           (6, "two words", "en", "b"), (7, "naïve café 😀 ñandú", "es", "c"), (None, "an id is missing here", "en", "c"),
           (None, "an id is missing here", "en", "c"), (8, "12 34 -- !!", "de", "c"), (9, "x " * 3000, "en", "a")]
    out.append((10, sentence(rng, 30_000, words), "en", "a"))
    base = sentence(rng, 220, words)
    out += [(20 + i, base, "en", "a") for i in range(6)]
    for i in range(30):
        own = base.split()
        for _ in range(i % 7):
            own[rng.randrange(len(own))] = rng.choice(words)
        out.append((40 + i, " ".join(own), "en", "ab"[i % 2]))
    for i in range(40):
        out.append((100 + i, sentence(rng, rng.choice([5, 40, 60, 120, 300]), words) + ".\n" + "Shared line of a page.\n" * (i % 3), "en", rng.choice(["a", "b", None, "c"])))
    out.append(out[-1])
    out.append((100, "another text under an id that exists " * 3, "en", "b"))
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return make(spark, rows).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return make(spark, [])
