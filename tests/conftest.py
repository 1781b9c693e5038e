import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession, functions as F

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("leadweave-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="leadweave-tests-"))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def apply(spark):
    """Apply a column function to a list of strings and return the results."""

    def apply_(fn, values, schema="v string"):
        rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
        names = [part.split()[0] for part in schema.split(",")]
        df = spark.createDataFrame(rows, "i int, " + schema)
        out = df.select("i", fn(*[F.col(n) for n in names]).alias("r")).orderBy("i").collect()
        return [r["r"] for r in out]

    return apply_
