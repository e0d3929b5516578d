"""Small document tables for the operator tests."""

import random

import pytest

SPACES = " \t\n\r\x0b\x0c"


@pytest.fixture(scope="session")
def words():
    rng = random.Random(3)
    syllables = ["an", "be", "co", "dé", "en", "fi", "go", "ü", "ka", "lo", "mi", "ß"]
    return ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(400)]


@pytest.fixture(scope="session")
def corpus(words):
    """(doc_id, text) with exact and near copies, shared passages, odd spaces,
    empty, blank, null and very long texts."""
    rng = random.Random(7)

    def prose(n):
        return [rng.choice(words) for _ in range(n)]

    passage, line = prose(60), prose(15)
    texts = []
    for i in range(60):
        body = prose(rng.randint(1, 160))
        if i % 4 == 0:
            at = rng.randint(0, len(body))
            body[at:at] = passage if i % 8 else passage[:40] + prose(3) + passage[40:]
        if i % 5 == 0:
            body += line
        texts.append("".join(w + rng.choice(SPACES) * rng.randint(1, 2) for w in body))
    for i in range(12):                         # near and exact copies
        base = texts[i * 3].split()
        for j in range(4):
            copy = list(base)
            for _ in range(j):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy).upper() if j == 1 else " ".join(copy))
    texts += [None, "", "   ", "\n\t", "one", "One two three", "one two THREE", " ".join(prose(20_000)), "x" * 30_000,
              "Ünï ÄB", "ünï Äb", " a  b ", "a b"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with columns whose names operators use themselves."""
    schema = "doc_id long, text string, id string, node long, keep_id int, ids string, words long, hit int, row string"
    rows = [(i, t, "x", None, 1, "y", 2, 3, "z") for i, t in corpus]
    return spark.createDataFrame(rows, schema).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
