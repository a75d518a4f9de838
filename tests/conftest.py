"""A session, and small data folders with the schemas of the real tables."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
DATA = "/root/testdata/sf0.001"
TABLES = "intents stages actions episode_traces tasks raw_records documents sites lang_labels mix_targets embeddings events".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from trailmill.session import local_session

    s = local_session(4, 4, "4g", **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("cp"))})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def schemas(spark):
    return {t: spark.read.parquet(f"{DATA}/{t}.parquet").schema for t in TABLES}


@pytest.fixture
def folder(spark, schemas, tmp_path):
    """folder(table=[dict, ...]) writes those tables and leaves all others empty; returns the path."""

    def make(extra: bool = False, **rows: list[dict]) -> str:
        for t in TABLES:
            data = [tuple(r.get(f.name) for f in schemas[t].fields) for r in rows.get(t, [])]
            df = spark.createDataFrame(data, schemas[t])
            if extra:
                df = df.selectExpr("*", "'x' as rep", "1 as n", "'y' as key", "2 as seq", "'z' as form")
            df.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / f"{t}.parquet"))
        return str(tmp_path)

    return make
