import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, norm string, class string, size string, row string, uid string, _row string, rate string, label string"


def doc(doc_id, text, lang="en", source="a"):
    """A document with extra columns whose names the operators use inside."""
    return (doc_id, text, lang, source, len(text) if text is not None else None, 1, "x", "x", "x", "x", "x", "x", "x", "x")


LONG = "the quick brown fox jumps over the lazy dog and runs away from all of them " * 3000
ODD = [
    doc(1, None),
    doc(2, ""),
    doc(3, "Same TEXT here, and it goes on for a while longer than five words"),
    doc(4, "same text here, and it goes on for a while longer than five words"),
    doc(5, "same text here, and it goes on for a while longer than five words"),
    doc(5, "same text here, and it goes on for a while longer than five words"),
    doc(6, "one two"),
    doc(7, "One  TWO", None, None),
    doc(8, LONG, "en", None),
    doc(9, LONG + " end"),
    doc(None, "no id at all but a text with several words in it", "en", "b"),
    doc(10, "x" * 5000, "de", "b"),
    doc(11, "été déjà ÀÉÎ straße 漢字 🎉 <|endoftext|>", "fr", "c"),
    doc(12, "123 456 --- !!!", None, "c"),
    doc(13, "   \t\n  ", "es", "c"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
