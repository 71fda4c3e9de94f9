import random

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def words():
    r = random.Random(11)
    syllables = "ba ce di fo gu ha je ki lo mu".split()
    return ["".join(r.choices(syllables, k=r.randint(1, 3))) for _ in range(80)]


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, extra=False):
        rows = [(d, t, "en", "s", len(t or "")) for d, t in rows]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        if extra:  # names that operators use themselves
            for c in ("key", "fp", "score", "component_id", "n_words", "start", "_kept", "a", "b"):
                from pyspark.sql import functions as F

                df = df.withColumn(c, F.lit("clash"))
        return df

    return make
