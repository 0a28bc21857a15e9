import os

import pytest

TOKENIZERS = os.environ.get("CHRONOLITH_TOKENIZERS", "/opt/tokenizers")


@pytest.fixture(scope="session")
def ranks_path():
    return f"{TOKENIZERS}/byte_bpe_50k.tiktoken"


@pytest.fixture
def docs_frame(spark):
    """Documents with columns whose names clash with internal ones."""
    from pyspark.sql import functions as F

    def make(texts, first=0):
        df = spark.createDataFrame([(first + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
        return df.withColumns({"pair": F.lit(1), "ids": F.lit("x"), "item_id": F.lit(0)})

    return make
