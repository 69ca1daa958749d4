import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from postlens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "tests", **{"spark__sql__shuffle__partitions": "4"})
    yield session
    session.stop()


@pytest.fixture
def column(spark):
    """Apply a column function to literal values, in order."""
    from pyspark.sql import functions as F

    def run(values, fn, prepare=None):
        rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
        n = len(rows[0]) - 1
        df = spark.createDataFrame(rows, "i int, " + ", ".join(f"a{k} string" for k in range(n)))
        if prepare:
            df = df.withColumn("a0", prepare(F.col("a0")))
        out = df.select("i", fn(*[F.col(f"a{k}") for k in range(n)]).alias("r")).collect()
        return [r.r for r in sorted(out, key=lambda r: r.i)]

    return run
