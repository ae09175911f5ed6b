import pytest
from pyspark.sql import types as T

from wavecohort.llm.shipping import ship

#: Names that the operators use themselves, as extra columns of the input.
CLASHING = ("doc", "copy", "rest", "version", "packed", "gone", "h", "id", "fp", "part", "length", "sketch", "_range", "lang_pred", "n_words", "n_lines")


@pytest.fixture(scope="session")
def sent(spark):
    """The session, with the package on its workers."""
    return ship(spark)


@pytest.fixture(scope="session")
def make(sent):
    """A documents table with clashing extra columns from (doc_id, text) pairs."""
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
    schema = T.StructType(fields + [T.StructField(c, T.StringType()) for c in CLASHING])

    def table(rows):
        return sent.createDataFrame([(i, t, *[c.upper() for c in CLASHING]) for i, t in rows], schema).repartition(3)

    return table


@pytest.fixture(scope="session")
def odd():
    """Nulls, blanks, short and long texts, repeats, a row without id."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    shared = " ".join(f"shared{i}" for i in range(40))
    return [
        (5, None), (6, ""), (7, " \t\n "), (8, "one"), (9, "one two"), (10, long), (11, f"Head of it {shared} tail"),
        (12, f"{shared}\nother end"), (13, f"Head of it {shared} tail"), (13, f"Head of it {shared} tail"),
        (None, "no id at all but words"), (14, "Ünïcode 😀 wörds über alles und noch mehr"), (15, "a  b   c \n\n d"), (16, "123 456"),
    ]
