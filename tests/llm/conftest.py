import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators use inside or in their results.
CLASH = ["score", "class_id", "hits", "items", "domain", "copies", "n_tokens", "node", "doc", "gone", "h", "bucket", "blob", "line", "comp", "links", "rank", "kept"]


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary):x}" for _ in range(n)]


def make_docs(seed=1, n=60):
    """Random documents with exact copies, near copies, shared passages and repeated lines."""
    rng = random.Random(seed)
    texts = []
    passage = " ".join(words(rng, 40))
    for k in range(n):
        kind = rng.random()
        if kind < 0.15 and texts:
            t = rng.choice(texts)
        elif kind < 0.4 and texts:
            w = rng.choice(texts).split(" ")
            for _ in range(max(1, len(w) // 40)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(99)}"
            t = " ".join(w)
        else:
            lines = [" ".join(words(rng, rng.randrange(1, 30))) for _ in range(rng.randrange(1, 8))]
            if kind > 0.7:
                lines.insert(rng.randrange(len(lines) + 1), passage)
            t = "\n".join(lines)
        texts.append(t)
    return [(k, t, rng.choice(["en", "de", "fr"]), f"src{rng.randrange(20)}", len(t)) for k, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark):
    rows = make_docs()
    return spark.createDataFrame(rows, DOC).repartition(3), rows


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank, junk and very long texts, repeated rows, clashing columns."""
    long = " ".join(words(random.Random(3), 60_000, 5000))
    same = (7, "one two three four five six seven\nanother line here", "en", "src1", 3)
    rows = [
        (None, "text without an id but with quite a few words in it", "en", "src1", 1),
        (None, None, None, None, None),
        (1, None, "en", "src1", 0),
        (2, "", "de", None, 0),
        (3, " \n\n ", None, "src2", 3),
        (4, "*** !!! ###\n***", "fr", "src3", 5),
        (5, long, "en", "src1", len(long)),
        (6, long, "en", "src1", len(long)),
        same, same,
        (8, "naïve café ça 漢字 русский\u0000nul \U0001f600", "fr", "src4", None),
        (9, "x" * 5000, "en", "src5", 5000),
        (-3, "negative id with some words to read here", "en", "src6", 10),
    ]
    df = spark.createDataFrame(rows, DOC)
    for c in CLASH:
        df = df.selectExpr("*", f"cast('x' as string) as {c}")
    return df, rows


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def bench(spark):
    rows = [(1, "one two three four five six seven"), (2, None), (None, "another line here"), (3, "!!"), (1, "one two three four five six seven")]
    return spark.createDataFrame(rows, "item_id long, text string")
