import importlib
import subprocess
import sys


def test_every_oracle_has_a_query():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 70


def test_library_without_the_subpackage():
    code = "import sys; sys.modules['lekhani.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rpartition("/tests/")[0])
