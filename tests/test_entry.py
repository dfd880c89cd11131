"""The driver's contract, with and without the training-data operators."""

import subprocess
import sys

import __spark_entry__ as entry


def test_names_and_flagship(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["depth", "symbols", "tests"]


def test_imports_without_the_subpackage():
    code = (
        "import importlib.util as u, sys\n"
        "real = u.find_spec\n"
        "u.find_spec = lambda n, *a: None if n in ('grafwerk.llm', 'corpus_pipeline') else real(n, *a)\n"
        "import __spark_entry__ as e\n"
        "assert len(e.queries()) > 80 and not any(n.startswith('op') for n in e.queries()) and 'pipeline' not in e.queries()\n"
        "assert 'grafwerk.llm' not in sys.modules\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True)
