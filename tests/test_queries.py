import pytest

from sparkloom.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(name, same):
    same(QUERIES[name], ORACLE_SQL[name])


def test_entry_needs_no_corpus_operators(tmp_path):
    """The package without its corpus operators still gives all other queries."""
    import shutil
    import subprocess
    import sys

    from conftest import ROOT

    shutil.copytree(ROOT / "sparkloom", tmp_path / "sparkloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'fulltext_and' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
