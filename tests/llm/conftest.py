import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    """documents([(doc_id, text), ...]): a frame with the columns of documents."""

    def make(rows):
        full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, COLUMNS).repartition(2)

    return make


@pytest.fixture(scope="session")
def clashing(spark):
    """A frame whose further columns have names that the operators use inside."""

    def make(df):
        names = "_id _h row n key k1 k2 raw print mask words lines fertility block part window start pos conv at text_1"
        from pyspark.sql import functions as F

        have = {c.lower() for c in df.columns}
        return df.withColumns({c: F.lit("x") for c in names.split() if c not in have})

    return make
