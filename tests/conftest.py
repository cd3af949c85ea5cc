import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from rolesift.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[*]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Evaluate a column function over a list of input tuples, in order."""
    def run(schema, rows, *columns):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                                   f"_i int, {schema}")
        got = df.select("_i", *[c.alias(f"c{n}") for n, c in enumerate(columns)]) \
            .orderBy("_i").collect()
        return [tuple(r)[1:] if len(columns) > 1 else r["c0"] for r in got]
    return run
