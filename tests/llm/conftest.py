import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _n int, key string, rank long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, empty and very long texts, ties, repeats and near copies."""
    rng = random.Random(5)
    base = [words(rng, rng.randint(1, 120)) for _ in range(40)]
    texts = list(base)
    for t in base[:15]:
        w = t.split()
        texts.append(" ".join(w[:-1] + ["changed"]) if len(w) > 1 else t)
        texts.append(t)
    texts += [None, None, "", "", " \n\t", "é", "Ünï cödé ÀÉ", "12 34", words(rng, 9000), "x" * 7000, "日本語 テキスト", "A b C", "a B c", "it's , ok.\x1cy"]
    out = [(i, t, ["en", "de", None][i % 3], "s", None if t is None else len(t), 1, "k", 2) for i, t in enumerate(texts)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The documents, with extra columns whose names clash with inner ones."""
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
