import datetime as dt
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from cohortloom.session import configure  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[8]").appName("tests")
               .config("spark.ui.enabled", "false")
               .config("spark.sql.shuffle.partitions", "4")
               .config("spark.driver.memory", "4g")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
               .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    return configure(session)


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def rows(df, *order):
    """Rows as sorted tuples."""
    picked = df.select(*order) if order else df
    return sorted((tuple(r) for r in picked.collect()),
                  key=lambda t: tuple((v is not None, v) for v in t))
