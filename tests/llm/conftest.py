import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture()
def table(spark):
    """Rows with the columns of ``documents`` in several partitions."""

    def make(texts, ids=None, **more):
        rows = [(i, t, *(more[k][n] for k in more)) for n, (i, t) in enumerate(zip(ids if ids is not None else range(len(texts)), texts, strict=True))]
        kinds = {"lang": "string", "source": "string", "n_chars": "long", "quality": "int"}
        schema = ", ".join(["doc_id long", "text string", *(f"{k} {kinds[k]}" for k in more)])
        return spark.createDataFrame(rows, schema).repartition(3)

    return make
