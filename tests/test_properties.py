"""Property test: blocked windows equal pandas for random series, panels and block sizes."""

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings, strategies as st

from surgecast.operators import features as feat


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(min_value=5, max_value=160), block=st.integers(min_value=13, max_value=70),
       seed=st.integers(min_value=0, max_value=10_000), two=st.booleans())
def test_blocked_features_match_pandas(spark, n, block, seed, two):
    rng = np.random.default_rng(seed)
    frames = []
    for key in (["a", "b"] if two else ["a"]):
        start = pd.Timestamp("2023-12-25") + pd.Timedelta(days=int(rng.integers(0, 9)))
        m = n if key == "a" else int(rng.integers(3, n + 3))
        frames.append(pd.DataFrame({"k": key, "TimePeriod": pd.date_range(start, periods=m, freq="D"),
                                    "Volume": rng.integers(0, 1000, m).astype(float)}))
    pdf = pd.concat(frames, ignore_index=True)
    df = spark.createDataFrame(pdf, "k string, TimePeriod timestamp, Volume double")
    got = (feat.window_features(df, "D", ["k"], lags=(1, 7), rolling=(7,), spans=(7, 28), calendar=False,
                                regime=False, block_size=block)
           .toPandas().sort_values(["k", "TimePeriod"]).reset_index(drop=True))
    for key, g in pdf.groupby("k"):
        s = g.sort_values("TimePeriod")["Volume"].reset_index(drop=True)
        out = got[got.k == key].reset_index(drop=True)
        exp = {"Volume_Lag1": s.shift(1), "Volume_Lag7": s.shift(7), "Volume_RollingMean7": s.rolling(7).mean(),
               "Volume_RollingStd7": s.rolling(7).std(), "Volume_EMA7": s.ewm(span=7).mean(),
               "Volume_EMA28": s.ewm(span=28).mean()}
        for c, e in exp.items():
            np.testing.assert_allclose(out[c].to_numpy(float), e.to_numpy(float), rtol=1e-9, atol=1e-7,
                                       equal_nan=True, err_msg=f"{c} n={n} block={block} key={key}")
