import importlib.util
import os
import subprocess
import sys

import __spark_entry__ as entry


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[:2] == ["runtime", "session_id"]


def test_registry():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) >= 43


def test_without_the_training_operators():
    """The rest works without them; a dependency that they lack is not hidden."""
    code = "import sys; sys.modules[{!r}] = None\nimport __spark_entry__ as e\nprint(len(e.queries()), len(e.oracle_sql()), any(q.startswith('op') for q in e.queries()))"
    run = lambda missing: subprocess.run([sys.executable, "-c", code.format(missing)], cwd=os.path.dirname(os.path.dirname(__file__)), capture_output=True, text=True, timeout=120)
    for missing in ("skein.llm", "corpus_pipeline"):
        n, m, some = run(missing).stdout.split()
        assert int(n) == int(m) >= 55 and some == "False"
    if importlib.util.find_spec("skein.llm"):
        assert "ModuleNotFoundError" in run("zstandard").stderr
