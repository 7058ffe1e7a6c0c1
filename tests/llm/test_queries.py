"""The queries against their SQL, and the imports that must not be."""

import subprocess
import sys
from pathlib import Path

import pytest

from millrace.llm import queries

ROOT = Path(__file__).resolve().parents[2]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(name, same_as_sql):
    same_as_sql(queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_native_queries_run_no_python(spark):
    from support import SF

    for name in ("op1_exact_dedup", "op2_secret_scan", "op5_decontamination", "op10_line_dedup"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert not any(w in plan for w in ("Python", "Pandas", "MapInArrow"))


def test_core_does_not_import_llm():
    code = "import sys; from millrace import registry; sys.exit(any(m.startswith('millrace.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=False).returncode == 0
