import os

import pytest

from tallyweave import plans, registry  # noqa: F401
from tests.compare import connect, rows_of, rows_of_sql


@pytest.fixture(scope="session")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, sf_dir, con, name):
    got = rows_of(registry.QUERIES[name](spark, sf_dir))
    if name in registry.ORACLES:
        assert got == rows_of_sql(con, registry.ORACLES[name])
    else:
        assert name == "tree_edit_accuracy" and got[1]


def test_entry_imports_without_the_corpus_operators(tmp_path):
    """The library must work where the corpus subpackage and its pipeline are not installed."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/tallyweave", tmp_path / "tallyweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'split_bills' in e.queries() and 'pipeline' not in e.queries() and not any(k.startswith('op') and k[2].isdigit() for k in e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)
