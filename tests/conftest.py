import glob
import os
import sys

import duckdb
import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from gleanery.session import local_session  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 8, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def training_frame(spark, x: np.ndarray, y: np.ndarray):
    """(row_id, features, label) from arrays."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    pdf = pd.DataFrame({"row_id": [f"r{i:06d}" for i in range(len(x))], "x": x.tolist(), "label": y.astype(float)})
    df = spark.createDataFrame(pdf, "row_id string, x array<double>, label double")
    return df.select("row_id", array_to_vector("x").alias("features"), "label").repartition(4, F.col("row_id"))
