import pytest

from sightline.plans import catalog
from tests.compare import connect, rows, sql_rows


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, sf, duck, name):
    assert rows(catalog.QUERIES[name](spark, sf)) == sql_rows(duck, catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_has_rows(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).columns


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_entry_imports_without_llm(tmp_path):
    """The library works where the llm folders are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).parents[1]
    shutil.copytree(root / "sightline", tmp_path / "sightline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(n.startswith('op') for n in q)"], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr


def test_entry_imports_without_llm_beside_another_pipeline(tmp_path):
    """As above, where another copy of corpus_pipeline is on the path."""
    import os
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).parents[1]
    shutil.copytree(root / "sightline", tmp_path / "sightline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    (tmp_path / "elsewhere").mkdir()
    shutil.copy(root / "corpus_pipeline.py", tmp_path / "elsewhere")
    path = os.pathsep.join([str(tmp_path / "elsewhere"), os.environ.get("PYTHONPATH", "")])
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": path}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
