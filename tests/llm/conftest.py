import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))

SENTENCE = "the quick brown fox jumps over the lazy dog and runs far away from the big bad wolf today "


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and very long texts, ties, repeated rows, and extra columns whose
    names operators use inside."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    rows = [
        (1, "", "en", "a", 0, "x", 1), (2, None, "en", "a", 0, "x", 1), (3, SENTENCE * 3, None, None, None, None, None), (4, SENTENCE * 3, "en", "b", 5, "y", 2),
        (5, long, "en", "b", 9, "y", 2), (5, long, "en", "b", 9, "y", 2), (None, "a document without an id", "en", "c", 1, "z", 3), (6, "\n \t ", "en", "c", 1, "z", 3),
        (7, "one two three", "en", "c", 1, "z", 3), (8, "ONE two  THREE", "en", "c", 1, "z", 3), (9, "漢字かな交じり文 <|endoftext|> é́ ​", "en", "c", 1, "z", 3), (10, "x" * 5000, "en", "c", 1, "z", 3),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _kept string, id long").withColumns({c: __import__("pyspark").sql.functions.lit(1) for c in ("key", "part", "ids", "signature", "component", "n", "s")})


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def texts(duck):
    return duck.execute("select doc_id, text from documents order by doc_id").fetchall()
