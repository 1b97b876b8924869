import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from gradpath.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(int(os.environ.get("TEST_CPUS", "8")), "gradpath-tests", **{"spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "4"})


@pytest.fixture(scope="session")
def tiny_catalogue(spark):
    rows = [
        (1, "Job A", "x1 , y1", None, "z1"),  # void: null languages
        (2, "Job B", "x1,y1", "", "C, R, ,\tGo \n"),
        (3, "Job C", "x1,w1", "Go", None),
        (4, "SQL", "x1,q1", "", ""),
        (5, "Job D", "SQL,q1", "", ""),
        (6, "Job B", "y1,x1", "Rust", ""),
        (7, "Isle", "lone1", "", ""),
    ]
    return spark.createDataFrame(rows, "row_id bigint, job string, skills string, langs string, tools string")
