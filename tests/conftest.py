import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from bench import session
    from panelmill.shipping import ship

    spark = session("4")
    ship(spark)
    return spark


@pytest.fixture(scope="session")
def panel(spark):
    """A small random panel: 12 months, 60 names, ties and missing values."""
    import datetime as dt

    import numpy as np

    rng = np.random.default_rng(7)
    rows = []
    for i in range(12):
        m = dt.date(2000 + (i + 1) // 12, (i + 1) % 12 + 1, 1) - dt.timedelta(days=1)
        for s in range(60):
            v = float(np.round(np.exp(rng.normal(0, 2)), 2)) if s % 3 else 0.0
            rows.append((m, s, None if s % 17 == 5 else v, float(rng.normal()), float(rng.integers(0, 4)), float(abs(rng.normal()) + 0.1)))
    return spark.createDataFrame(rows, "m date, sec_id long, x double, y double, z double, w double").cache()
