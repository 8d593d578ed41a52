import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_fixtures import AWKWARD  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, rep string, row int, _key string, _range int, size int, band long, component int"


@pytest.fixture(scope="session")
def docs(spark):
    """texts (with or without ids and sources) -> documents with extra columns that clash with inner names."""
    def make(*rows):
        full = [(*(r if isinstance(r, tuple) else (i, r)), *(None,) * (4 - len(r if isinstance(r, tuple) else (i, r)))) for i, r in enumerate(rows)]
        data = [(i, text, "en", source, None, 7, "x", 1, "k", 3, 5, 9, 2) for i, text, source, _ in full]
        return spark.createDataFrame(data, SCHEMA).repartition(3)

    return make


@pytest.fixture(scope="session")
def awkward(docs):
    return docs(*AWKWARD)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
