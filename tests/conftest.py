import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from decumano.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 4)
    s.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    yield s


def rows(df, *order):
    return sorted((tuple(r) for r in df.collect()), key=repr)
