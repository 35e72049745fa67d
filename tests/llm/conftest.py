import pytest

from paddock.llm.queries import workers_find_library

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark():
    from paddock.session import local_session
    s = local_session(cores="*", shuffle_partitions=4, app="paddock-llm-tests")
    workers_find_library(s)
    yield s


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source) rows, with clashing extra columns."""
    def make(rows):
        full = [(*r, None, None, None)[:4] + (len(r[1]) if r[1] is not None else None,) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        return df.selectExpr("*", "'x' AS id", "1 AS x", "2 AS key", "'t' AS row", "0 AS spans", "1 AS far")
    return make
