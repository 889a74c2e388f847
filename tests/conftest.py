import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (SparkSession.builder.master("local[4]").appName("surgecast-tests")
         .config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    from surgecast.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(s)
    yield s


@pytest.fixture
def daily_series(spark):
    """60 days from 2024-01-01, seed 42, integers 50..299 as float."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(42)
    idx = pd.date_range("2024-01-01", periods=60, freq="D")
    pdf = pd.DataFrame({"TimePeriod": idx, "Volume": rng.integers(50, 300, 60).astype(float)})
    return pdf, spark.createDataFrame(pdf, "TimePeriod timestamp, Volume double")


@pytest.fixture
def hourly_series(spark):
    """240 hours from 2024-01-01, seed 42, integers 0..49 as float."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(42)
    idx = pd.date_range("2024-01-01", periods=240, freq="h")
    pdf = pd.DataFrame({"TimePeriod": idx, "Volume": rng.integers(0, 50, 240).astype(float)})
    return pdf, spark.createDataFrame(pdf, "TimePeriod timestamp, Volume double")
