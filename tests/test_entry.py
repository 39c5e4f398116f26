"""The entry module: importable without a session, every engine query with SQL."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path


def test_import_needs_no_session():
    code = "import __spark_entry__ as e; from quire import catalog_of_queries as own; assert set(own.queries()) == set(own.oracle_sql()) and set(own.queries()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, check=True, timeout=120)
