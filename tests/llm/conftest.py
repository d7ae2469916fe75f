import pytest

import linkrank.llm.catalog as catalog
from linkrank.llm.stages import ship_code


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with the columns of the given table, and one that clashes with working names."""
    ship_code(spark)

    def make(rows):
        """From (doc_id, text) or (doc_id, text, source)."""
        full = [(i, t, "en", (r or ["src0"])[0], None if t is None else len(t), "x") for i, t, *r in rows]
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, tie string"
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def run(spark):
    return lambda name, folder: catalog.QUERIES[name](spark, folder)
