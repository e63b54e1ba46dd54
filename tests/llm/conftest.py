import pytest

#: Nulls, empty and very long texts, ties and repeated rows, and columns whose names operators use themselves.
ODD = "doc_id long, text string, lang string, source string, n_chars long, kept_text string, toxic string, size string, component_id string, position string, list string, bands string"
LONG = " ".join(f"w{k % 977}" for k in range(60_000))


def odd_rows():
    base = [(None, None), (None, "lost words here"), (1, None), (2, ""), (3, "a b"), (3, "a b"), (3, "other text under the same id"), (4, LONG), (5, LONG), (6, "   \n\t "), (7, "a b"), (8, "\n\n"), (-9, "é ü ß <|endoftext|> x　y \U0001f600")]
    return [(i, t, None, [None, "s1", "s2"][k % 3], None, "k", "t", "s", "c", "p", "l", "b") for k, (i, t) in enumerate(base)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], ODD)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
