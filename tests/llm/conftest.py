import random

import pytest

WORDS = "amber brook cedar delta ember fjord grove heath inlet jetty knoll lagoon marsh niche oasis plain quay ridge".split()


def sentence(r, n):
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with copies, near copies, shared passages, nulls, blanks, odd spaces and a long text."""
    r = random.Random(4)
    texts = [sentence(r, r.randrange(5, 160)) for _ in range(60)]
    passage, line = sentence(r, 60), "A Line that Many hold, again and again."
    texts += [f"{sentence(r, 20)} {passage} {sentence(r, r.randrange(30))}\n{line}" for _ in range(12)]
    texts += [f"  {line.upper()}\t\n{sentence(r, 12)}\n\n{line}" for _ in range(6)]
    base = sentence(r, 200).split()
    for _ in range(14):
        w = list(base)
        for _ in range(r.randrange(0, 7)):
            w[r.randrange(len(w))] = "edit" + str(r.randrange(10 ** 6))
        texts.append(" ".join(w))
    texts += [texts[0], texts[0].upper(), texts[3], None, None, "", " \t ", "one", "two words", "one", "é É ß 日本 語 x y z"]
    texts += ["go " * 300, sentence(r, 6000), passage + " " + passage]
    out = [(i * 3, t, ("en", "de", None)[i % 3], ("big", "big", "small", None)[i % 4], len(t or "")) for i, t in enumerate(texts)]
    return out + [out[5]]  # one repeated row


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, docs):
    """Extra columns named like those that operators work with."""
    from pyspark.sql import functions as F

    names = ["row", "ids", "node", "gone", "kept", "spans", "slot", "number", "score", "group", "id", "same", "hash", "words"]
    return docs.select("*", *[F.lit(n).alias(n) for n in names])
