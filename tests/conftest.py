import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from check_queries import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("8", **{
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.shuffle.partitions": "2",
        # Compiling wide expressions costs more than the few test rows.
        "spark.sql.codegen.wholeStage": "false",
        "spark.sql.codegen.factoryMode": "NO_CODEGEN",
    })
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Value of an expression over one row of named strings."""
    def value(build, **row):
        schema = ", ".join(f"{k} string" for k in row) or "_x string"
        return spark.createDataFrame([tuple(row.values()) or ("",)], schema).select(build().alias("v")).first()["v"]

    return value
