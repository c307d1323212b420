"""Results do not depend on the zone of the driver process."""

import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import json
from graphweft.operators import features as ft, temporal as tp
from graphweft.session import get_spark
from graphweft.sources import driver_tables as dt
spark, sf = get_spark("local[2]", 2), "/root/testdata/sf0.001"
snap = tp.build_snapshots(dt.users(spark, sf), dt.tweets(spark, sf), dt.edges(spark, sf))
counts = [[str(r.snapshot_idx), r.num_users, r.num_tweets, r.num_edges] for r in tp.snapshot_counts(snap).collect()]
e = dt.edges(spark, sf)
block = sorted([r.id, [round(x, 6) for x in r.numeric]] for r in ft.numeric_block(dt.user_records(spark, sf, e), e).collect())
print("RESULT" + json.dumps([snap.grid.start.isoformat(), snap.grid.count, counts, block]))
"""


def _run(zone):
    env = {**os.environ, "TZ": zone, "PYTHONPATH": ROOT}
    done = subprocess.run([sys.executable, "-c", CODE], env=env, cwd=ROOT, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    return json.loads(done.stdout.split("RESULT")[1])


def test_grid_counts_and_ages_in_another_zone():
    assert _run("America/New_York") == _run("UTC")
