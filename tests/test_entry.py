"""The entry module lists its queries without a session, with or without the optional subpackage."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def listed(before=""):
    code = before + "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120, check=True)
    return done.stdout.split()


def test_queries_are_listed_without_a_session():
    assert "reconcile_rent" in listed()


def test_queries_are_listed_without_the_optional_subpackage():
    names = listed("import sys; sys.modules['unitwise.llm'] = None; sys.modules['corpus_pipeline'] = None; ")
    assert "reconcile_rent" in names and not [n for n in names if n == "pipeline" or n.startswith("op1_")]
