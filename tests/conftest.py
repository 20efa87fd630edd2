import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def plans(monkeypatch):
    """Plans of all tables written meanwhile, with counted lookups shuffled: what they still broadcast is by estimate."""
    from landweave import session

    seen, stored = [], session.stored

    def watched(df, *args, **kwargs):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, *args, **kwargs)

    monkeypatch.setattr(session, "stored", watched)
    monkeypatch.setattr(session.F, "broadcast", lambda df: df.hint("merge"))
    return seen
