from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from corpusloom.session import local_session

    shared = tmp_path_factory.mktemp("shared")
    session = local_session(4, **{
        "spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": str(shared),
    })
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """``rows(df)``: the rows of a DataFrame as plain tuples, sorted."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
