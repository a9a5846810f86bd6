import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from podium.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "podium-tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session


@pytest.fixture
def frame(spark):
    """Small tables from SQL VALUES, so that the size check knows they are small."""
    def make(schema: str, *rows):
        def lit(v):
            if v is None:
                return "NULL"
            if isinstance(v, bool):
                return str(v).upper()
            return f"'{v}'" if isinstance(v, str) else repr(v)
        names = [c.strip().split()[0] for c in schema.split(",")]
        types = [c.strip().split()[1] for c in schema.split(",")]
        values = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
        df = spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")
        return df.selectExpr(*[f"CAST({n} AS {t}) AS {n}" for n, t in zip(names, types)])
    return make


@pytest.fixture
def distributed(spark):
    """Force the range-partitioned plans."""
    spark.conf.set("podium.small.bytes", "0")
    yield
    spark.conf.unset("podium.small.bytes")
