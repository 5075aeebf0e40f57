import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def normal(frame):
    """Rows of a pandas frame as sorted tuples of text, columns by name."""
    import math

    import numpy as np

    def cell(v):
        if isinstance(v, (list, tuple, np.ndarray)):
            return str([cell(x) for x in v])
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("<NA>", "NaT"):
            return "NULL"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        if isinstance(v, str):
            return v
        try:
            x = float(v)
            return str(int(x)) if x == int(x) else repr(round(x, 9))
        except (TypeError, ValueError, OverflowError):
            return str(v)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(cell(v) for v in row) for row in frame.itertuples(index=False))
