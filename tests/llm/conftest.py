import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCUMENT = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("text", StringType()),
        StructField("lang", StringType()),
        StructField("source", StringType()),
        StructField("n_chars", LongType()),
    ]
)
PROSE = [
    "the quiet river bends around the old mill and the town beyond it sleeps until the bells",
    "a ship left the harbour at dawn with grain and timber for the islands in the far north",
    "nobody remembers who planted the orchard but every autumn the whole valley comes to pick",
]


@pytest.fixture(scope="session")
def documents(spark):
    def make(rows):
        """Documents from (id, text) or texts, with the other columns filled in."""
        pairs = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in pairs]
        return spark.createDataFrame(full, DOCUMENT)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank and very long texts, ties and repeated rows."""
    return [
        (0, None), (1, ""), (2, "   \n\n "), (3, "x" * 300_000), (4, "word " * 60_000),
        (5, "a b"), (6, "a b"), (7, PROSE[0]), (7, PROSE[0]), (None, PROSE[1]), (8, "😀 é\u0000 ß"),
    ]
