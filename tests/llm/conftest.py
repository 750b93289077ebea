import random

import pytest

SF = "/root/testdata/sf0.001"
#: Columns whose names operators might use themselves.
CLASH = ["key", "bucket", "part", "n", "row", "start", "set_id", "component", "score", "_slice", "_tag", "slice", "tag", "share", "bits"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and blank texts, a very long text, repeated rows, equal texts, and columns with clashing names."""
    rnd = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "the", "of", "and", "über", "naïve", "Ωmega", "日本"]
    say = lambda n: " ".join(rnd.choice(words) + str(rnd.randrange(50)) for _ in range(n))
    base = [say(60) for _ in range(8)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(base)]
    rows += [(8, None, None, None, None), (9, "", "en", "s", 0), (10, " \n\t ", "en", "s", 4), (11, "!!! 123", "en", "s", 7), (12, "one", "en", "s", 3), (13, say(40_000), "en", "s", 1)]
    rows += [(14, base[0], "en", "s", 1), (15, base[1] + " tail", "fr", "s", 1), (16, base[2], "en", "s", 1), (16, base[2], "en", "s", 1), (None, base[3], "en", "s", 1), (17, base[4][:200] + say(20), "en", "s", 1)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")
