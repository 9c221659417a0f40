"""The driver's contract, with or without the optional subpackage."""

import os
import subprocess
import sys

import __spark_entry__ as entry_module


def test_entry_and_names(spark):
    queries, oracles = entry_module.queries(), entry_module.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 50
    df = entry_module.entry(spark)
    assert df.columns == ["kmer", "count", "left", "right"] and df.count() > 0


def test_core_does_not_import_the_optional_part():
    """Nothing outside the folder imports it: the registered core queries load without it."""
    code = "import sys; sys.modules['strandlake.llm'] = None; from strandlake.plans import registry; import strandlake.streaming.counter; print(len(registry.QUERIES))"
    root = os.path.dirname(os.path.abspath(entry_module.__file__))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and int(out.stdout) > 50, out.stderr
