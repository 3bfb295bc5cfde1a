import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))
os.environ.setdefault("OMP_NUM_THREADS", "1")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "3g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def records(spark):
    """Makes records of (id, seq) or (id, seq, qual) or (id, seq, qual, desc)."""

    def make(*rows):
        full = [(0, i, r[0], r[3] if len(r) > 3 else None, r[1], r[2] if len(r) > 2 else None) for i, r in enumerate(rows)]
        return spark.createDataFrame(full, "file_ord int, ord long, id string, `desc` string, seq string, qual string")

    return make
