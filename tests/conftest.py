from __future__ import annotations

import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from linkwatch import schema as S  # noqa: E402
from linkwatch.session import local_test_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"
T0 = datetime(2024, 1, 30, 9, 0, 0)
AS_OF = S.FIXTURE_AS_OF


@pytest.fixture(scope="session")
def spark():
    s = local_test_session(cores=4, shuffle_partitions=8)
    yield s


def flags_to_rows(flags: str, host: str = "h1", start: datetime = T0, step_s: float = 10.0, first_id: int = 1):
    """'T' lost, 'F' ok, 'N' NULL flag; one probe per ``step_s`` seconds."""
    rows = []
    for i, ch in enumerate(flags):
        ts = start + timedelta(seconds=step_s * i)
        loss = {"T": True, "F": False, "N": None}[ch]
        rt = None if loss else 10.0 + i
        err = S.LOSS_MESSAGE if loss else None
        rows.append((first_id + i, ts, host, rt, loss, err, ts))
    return rows


def make_pm(spark, rows):
    return spark.createDataFrame(rows, S.METRICS_SCHEMA)
