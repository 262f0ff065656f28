import pytest
from pyspark.sql import functions as F

from trailmark.llm.common import prepare

BASE = "the quick brown fox jumps over the lazy dog and then runs far away from every hunter in the deep dark forest tonight"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, of long, h string, size long, key string, kept string"


def odd_rows():
    """Nulls, empty and blank texts, repeated rows and ids, copies, near copies, ties, one very long text."""
    words = BASE.split()
    near = " ".join([*words * 6, "extra"])
    texts = [
        (1, BASE), (2, BASE), (2, BASE), (3, None), (4, ""), (5, " \n\t "), (6, near), (7, near + " end"), (8, "Été à l'aube\n" + BASE),
        (9, "x"), (10, "x y"), (11, BASE.upper()), (12, ("lorem%d " * 3 % (1, 2, 3)) * 3000), (None, BASE), (None, None), (13, BASE + "\nother line of its own"),
        (14, "b\n" + BASE + "\nc"), (15, "<|endoftext|> it's \x1c odd"), (2, "another text of id two"),
    ]
    return [(i, t, None if i == 3 else "en", None if i in (4, 5) else f"s{(i or 0) % 3}", 1, 7, "h", 3, "k", "z") for i, t in texts]


@pytest.fixture(scope="session")
def llm(spark):
    return prepare(spark)


@pytest.fixture(scope="session")
def odd(llm):
    return llm.createDataFrame(odd_rows(), SCHEMA).cache()


@pytest.fixture(scope="session")
def none(llm):
    return llm.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(llm):
    return llm.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.lit(True))
