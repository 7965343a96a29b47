from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) rows, with the other columns and two that clash with names used inside."""

    def make(rows):
        rows = [(i, t, "en", "s", None if t is None else len(t), "x", 1.5) for i, t in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, score double")

    return make
