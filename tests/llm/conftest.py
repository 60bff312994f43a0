import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes documents from texts; ids count from 0."""

    def make(texts, ids=None, source="s"):
        ids = range(len(texts)) if ids is None else ids
        return spark.createDataFrame([(i, t, "en", source, None if t is None else len(t)) for i, t in zip(ids, texts)], SCHEMA)

    return make


