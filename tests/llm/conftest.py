import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark():
    from storewatch.session import local_session
    s = local_session(cores="*", shuffle_partitions=4, app="storewatch-llm-tests")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s


@pytest.fixture(scope="session")
def docs_of(spark):
    """Frame of (doc_id, text[, source]) rows with the columns of documents."""
    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOC_SCHEMA)
    return make


def split_words(text):
    return (text or "").encode().split()
