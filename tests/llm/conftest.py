import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: An extra column whose name an operator uses inside.
EXTRA = SCHEMA + ", b string, kept string, line string, fp long, h long, _row string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs, in several partitions, with columns whose names clash with operators' own."""

    def frame(rows, lang="en", source="s"):
        full = [(i, t, lang, source, None if t is None else len(t), "x", "y", "z", 7, 8, "r") for i, t in rows]
        return spark.createDataFrame(full, EXTRA).repartition(3)

    return frame


@pytest.fixture(scope="session")
def write(spark, tmp_path_factory):
    def table(df, name):
        folder = tmp_path_factory.mktemp("tables")
        df.write.parquet(str(folder / f"{name}.parquet"))
        return str(folder)

    return table
