import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from panelforge.session import build_session

    session = build_session(
        "panelforge-tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def monthly(spark):
    """24 months, rising with a yearly wave."""
    import datetime as dt
    import math
    import random

    rng = random.Random(42)
    rows = []
    for t in range(24):
        y = 800_000 + t * 700_000 / 23 + 100_000 * math.sin(2 * math.pi * t / 12) + rng.gauss(0, 30_000)
        ds = dt.date(2017 + t // 12, t % 12 + 1, 1)
        rows.append((ds, y, float(5000 + rng.randint(-500, 500)), 120 + rng.random() * 40, rng.gauss(0, 1)))
    return spark.createDataFrame(
        rows, "ds date, monthly_revenue double, monthly_orders double, avg_ticket double, feature_noise double"
    )
