import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    local = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    s = (
        SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", local).config("spark.sql.warehouse.dir", f"{local}/warehouse").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.environment.setdefault("PYTHONPATH", str(ROOT))
    yield s
    s.stop()
