"""The SQL of the corpus queries."""

import subprocess
import sys
from pathlib import Path


def test_sql_needs_no_session():
    """The driver may ask for the SQL before it starts Spark."""
    code = "import __spark_entry__ as e; assert 'op9_quality_rules' in e.oracle_sql() and 'pipeline' in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[2], timeout=120)
