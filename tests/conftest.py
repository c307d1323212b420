import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from graphweft.session import get_spark  # noqa: E402

SF_SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = get_spark("local[4]", 4, extra={"spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints"))})
    yield s


def T(s):
    return dt.datetime.strptime(s, "%Y-%m-%d %H:%M:%S")


@pytest.fixture(scope="session")
def micro(spark):
    """The micro-fixture of FIXTURES.md section 3."""
    users = spark.createDataFrame([
        ("u1", T("2020-01-01 10:00:00"), "human"),
        ("u2", T("2020-01-05 10:00:00"), "bot"),
        ("u3", T("2020-01-05 10:00:01"), "human"),
        ("u4", T("2020-01-20 00:00:00"), "human"),
        ("u5", T("2020-01-20 00:00:00"), "bot"),
    ], "id string, created_at timestamp, label string")
    tweets = spark.createDataFrame([
        ("t1", 1, T("2020-01-02 00:00:00"), "a"),
        ("t2", 1, T("2020-01-13 00:00:00"), "b"),
        ("t3", 2, T("2020-01-01 00:00:00"), "c"),
        ("t4", 4, T("2020-01-25 00:00:00"), None),
    ], "id string, author_id bigint, created_at timestamp, text string")
    rows = [
        ("u1", "following", "u2"), ("u1", "following", "u2"), ("u2", "followers", "u1"),
        ("u3", "following", "u1"), ("u3", "following", "u3"), ("u4", "following", "u9"),
        ("u1", "post", "t1"), ("u1", "post", "t2"), ("u2", "post", "t3"),
        ("u4", "post", "t4"), ("u3", "like", "t1"), ("u3", "like", "t1"), ("u3", "like", "t2"),
        ("t2", "mentioned", "u4"), ("u2", "membership", "l1"), ("l1", "contain", "t9"),
        ("t1", "discuss", "h1"), ("t9", "discuss", "h2"),
    ]
    edges = spark.createDataFrame(rows, "source_id string, relation string, target_id string")
    return {"users": users, "tweets": tweets, "edges": edges,
            "labels": users.select("id", "label")}


def as_dict(df, k, v):
    return {r[k]: r[v] for r in df.collect()}
