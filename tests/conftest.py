import pytest

from articleflow.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate a column over literal rows: one(rows, ddl, column) -> list of values."""

    def run(rows, ddl, column):
        df = spark.createDataFrame(rows, ddl)
        return [r[0] for r in df.select(column.alias("v")).collect()]

    return run
