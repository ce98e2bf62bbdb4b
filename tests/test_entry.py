import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_entry_without_the_text_operators():
    """Where they are gone, or lack something, all other queries are there."""
    code = "import sys; sys.modules['tidemark.llm'] = None; import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.plans.queries()), set(e.oracle_sql()) == set(e.plans.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(entry.__file__).parent, capture_output=True, text=True, timeout=100)
    assert done.stdout.split() == ["True", "True"], done.stderr


def test_sql_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_pushed_filters_reach_the_scan(spark, sf_dir):
    from tidemark.plans import queries as plans

    plan = plans.queries()["coupon_get"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,click)" in plan and "lineitem" not in plan
