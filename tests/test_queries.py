"""Every registered query against its DuckDB statement; queries without one give rows."""

from __future__ import annotations

import pytest

from barcraft.plans import registry
from tests.conftest import rows_of, rows_of_sql

QUERIES, ORACLES = registry.queries(), registry.oracles()
#: Queries without rows over the smallest tables (too few bars, too few releases); the next size has some.
MAY_BE_EMPTY = {"backtest_end_to_end", "noisy_releases"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_duckdb(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name not in ORACLES:
        assert df.count() > 0
        return
    found = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(found.columns)
    rows = rows_of(df)
    assert rows == rows_of_sql(duck, ORACLES[name])
    assert rows or name in MAY_BE_EMPTY, "an empty result proves nothing"


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_an_error_inside_the_optional_subpackage_shows(tmp_path):
    """With the subpackage there an ImportError in it is raised; without it the rest works."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "barcraft", tmp_path / "barcraft", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, capture_output=True, text=True)
    bare = run()
    assert bare.returncode == 0 and int(bare.stdout) == len(QUERIES)
    (tmp_path / "barcraft" / "llm").mkdir()
    (tmp_path / "barcraft" / "llm" / "__init__.py").write_text("")
    (tmp_path / "barcraft" / "llm" / "queries.py").write_text("import no_such_library_at_all")
    (tmp_path / "corpus_pipeline.py").write_text("")
    assert "no_such_library_at_all" in run().stderr
