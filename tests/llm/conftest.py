import pytest
from pyspark.sql import functions as F

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 9973} thing{i}" for i in range(60_000))
BASE = " ".join(f"alpha{i} beta{i % 7}" for i in range(60))


def texts() -> list[tuple]:
    """Nulls, empty and blank texts, a very long one, copies, near copies, repeated rows, texts beyond the plain range."""
    near = BASE.replace("alpha30", "omega")
    values = [None, "", " \n\t ", "one", "a b c d", BASE, BASE, BASE.upper(), near, LONG, "naïve café 日本語 😀 don't we'll", "x" * 5000, "The the of and to is in a b c d e f g\nline\nline\nline", "idiot you idiot"]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", len(t) if t else None) for i, t in enumerate(values)]
    return [*rows, rows[5], (None, BASE, "en", "s1", 3), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def documents(spark):
    return spark.createDataFrame(texts(), DOCUMENTS)


@pytest.fixture(scope="session")
def odd_documents(documents):
    """With columns whose names operators use themselves."""
    more = ["n_bytes", "perplexity", "kept", "size", "unit", "taken", "class_id", "component_id", "node", "score", "words", "_gone", "threshold"]
    return documents.withColumns({c: F.lit("x") for c in more})


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def labelled(spark):
    """(documents, labels): plain prose, junk of symbols, and prose with insults."""
    import random

    rng = random.Random(4)
    words = ["river", "stone", "water", "mountain", "light", "garden", "morning", "the", "of", "and", "quiet", "village", "road", "winter"]
    rows, labels = [], []
    for i in range(400):
        body = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        good, toxic = i % 8 != 0, i % 4 == 1
        if not good:
            body = [f"%%{w}$$#" for w in body]
        if toxic:
            for _ in range(3):
                body.insert(rng.randrange(len(body)), rng.choice(["idiot", "moron", "scumbag"]))
        rows.append((i, " ".join(body), "en", f"s{i % 3}", 1))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(rows, DOCUMENTS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
