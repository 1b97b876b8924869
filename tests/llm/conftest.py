import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from gradpath.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(int(os.environ.get("TEST_CPUS", "8")), "gradpath-tests", **{"spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "4"})


def rows(df, key="id"):
    """Rows as dicts, sorted; None first."""
    got = [r.asDict(recursive=True) for r in df.collect()]
    return sorted(got, key=lambda r: [(v is not None, v if isinstance(v, (int, float, str)) else str(v)) for v in r.values()])


@pytest.fixture
def documents(spark):
    def make(pairs, **extra):
        data = [(i, t, "src0", "en") for i, t in pairs]
        return spark.createDataFrame(data, "doc_id bigint, text string, source string, lang string")

    return make
