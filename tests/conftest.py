import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from postlens.session import build_session

    session = build_session("local[8]")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def values(spark):
    """Evaluate one expression over literal texts: ``values(fn, [text, …])`` -> list."""
    from pyspark.sql import functions as F

    def run(fn, texts):
        rows = [(i, t) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "i int, t string")
        return [r[0] for r in df.orderBy("i").select(fn(F.col("t")).alias("v")).collect()]

    return run
