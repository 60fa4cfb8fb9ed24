import math
import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from verdin.session import build_session
    s = build_session(master="local[*]", partitions=8, app="verdin-tests")
    yield s


@pytest.fixture
def hourly_consumption(spark):
    """120 hourly rows: 180 + 0.35 i + 22 sin(2πh/24) + 8 on weekdays / −4 on weekends."""
    rows = []
    start = datetime(2024, 1, 1)
    for i in range(120):
        ts = start + timedelta(hours=i)
        workday = 1 if ts.weekday() < 5 else 0
        y = 180 + 0.35 * i + 22 * math.sin(2 * math.pi * ts.hour / 24) + (8 if workday else -4)
        rows.append((ts.isoformat(), workday, y))
    return spark.createDataFrame(rows, "`Дата` string, `Рабочий день` long, `Электропотребление` double")


@pytest.fixture
def daily_regime(spark):
    """180 daily rows, level shift of +60 from row 150 on."""
    rows = []
    start = datetime(2024, 1, 1)
    for i in range(180):
        ts = start + timedelta(days=i)
        y = 120 + 2.4 * i + 60 * (i >= 150) + (5 if ts.weekday() < 5 else -7)
        rows.append((ts.isoformat(), i, 10 + (i % 7) * 1.5, float(y)))
    return spark.createDataFrame(rows, "timestamp string, period_index long, daily_temperature double, target double")


@pytest.fixture
def hour_only_energy(spark):
    rows = [(h, 15.0 + h * 0.5, 100.0 + h * 3.0 + (h % 3)) for h in range(10)]
    return spark.createDataFrame(rows, "`Час` long, `Температура` double, `Потребление` double")


@pytest.fixture
def timestamped_energy(spark):
    start = datetime(2024, 1, 1)
    rows = [((start + timedelta(hours=4 * i)).isoformat(), (4 * i) % 24, 10.0 + i, 200.0 + 5 * i) for i in range(10)]
    return spark.createDataFrame(rows, "`Дата` string, `Час` long, `Температура` double, `Потребление` double")


@pytest.fixture
def weather(spark):
    start = datetime(2024, 1, 1)
    rows = [((start + timedelta(hours=4 * i)).isoformat(), -5.0 + i, 0.1 * i) for i in range(10)]
    return spark.createDataFrame(rows, "dateByOurs string, `Температура наружная` double, `Облачность` double")
