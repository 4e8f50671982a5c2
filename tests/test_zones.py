"""Results do not depend on the time zone of the driver's machine."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import __spark_entry__ as entry_point
from shoplight.session import local_session
from tests.harness import connect, differences
root = "/root/testdata/sf0.001"
spark, duck = local_session(4), connect(root)
queries, checks = entry_point.queries(), entry_point.oracle_sql()
for name in ("flt_time_range", "agg_realtime", "agg_report", "agg_daily_orders", "ing_timestamp", "ing_page_views", "ord_keyset_page",
             "str_retention", "str_hourly", "str_sessions", "win_sessionise", "src_json_rows", "snk_append_counts"):
    problems = differences(queries[name](spark, root), duck, checks[name])
    assert not problems, (name, problems)
"""


def test_queries_agree_on_a_driver_outside_utc():
    home = Path(__file__).resolve().parent.parent
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT], cwd=home, env={**os.environ, "TZ": "America/New_York"}, capture_output=True,
        text=True, timeout=300, check=False,
    )
    assert done.returncode == 0, done.stderr[-2000:]
