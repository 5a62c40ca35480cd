import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from reviewloom.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("tests", "local[4]", **{
        "spark__sql__shuffle__partitions": "4", "spark__ui__enabled": "false",
        "spark__ui__showConsoleProgress": "false", "spark__driver__memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


REVIEW_SCHEMA = ("ingest_seq long, app_name string, store string, rating string, date string, "
                 "review_text string, version string, source_url string")


@pytest.fixture(scope="session")
def make_reviews(spark):
    """Reviews from (app, store, rating, date, text) tuples; the position is the ingest order."""
    def make(rows):
        full = [(i, a, s, r, d, t, "1.0", "url") for i, (a, s, r, d, t) in enumerate(rows)]
        return spark.createDataFrame(full, REVIEW_SCHEMA)
    return make
