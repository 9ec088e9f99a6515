import pytest

#: Columns and values that every operator on documents must bear.
EDGES = "doc_id long, text string, lang string, source string, n_chars long, spans string, kept boolean, label int, class long"


@pytest.fixture(scope="session")
def edge_docs(spark):
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [
        (1, None, None, None, None, "s", None, 1, 1),
        (2, "", "en", "h", 0, None, True, None, None),
        (3, " \n\t ", "en", "h", 4, "", False, 2, 2),
        (4, "one", "en", "h", 3, "x", None, 3, 3),
        (5, long, "en", "h", len(long), None, None, 4, 4),
        (6, "Same text that is here twice in all of its words and letters.", "en", None, 60, None, None, 5, 5),
        (7, "Same text that is here twice in all of its words and letters.", "en", "h", 60, None, None, 5, 5),
        (7, "Same text that is here twice in all of its words and letters.", "en", "h", 60, None, None, 5, 5),
        (None, "a row without an id but with some text in it, ten words or more", "en", "h", 63, None, None, 6, 6),
    ]
    return spark.createDataFrame(rows, EDGES)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], EDGES)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
