from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A documents table from (doc_id, text) pairs, with null in every other column and a clashing extra one."""

    def make(pairs, extra: bool = True):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(i, t, None, None, None) for i, t in pairs], DOCS)
        if extra:
            for name in ("length", "bin", "score", "key", "part", "fingerprint"):
                df = df.withColumn(name, F.lit("clash"))
        return df

    return make
