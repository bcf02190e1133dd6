"""Every query against its SQL on whole small tables."""

from __future__ import annotations

import datetime
import math
import os
from decimal import Decimal

import pytest

import __spark_entry__ as entry
from studylake.plans import registry


def plain(value):
    """A value in a form that both engines share."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (float, Decimal)):
        return float(f"{float(value):.6g}")
    if isinstance(value, datetime.datetime):
        return value.isoformat(sep=" ")
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(v[i]) for i in order) for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_equals_sql(name, spark, duck, sf_dir):
    found = registry.QUERIES[name](spark, sf_dir)
    want = duck.execute(registry.ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(found.columns) == sorted(columns)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(columns, want.fetchall())


def test_draw_is_repeatable_and_whole(spark, sf_dir):
    draw = registry.QUERIES["draw_undone_first"]
    first, again = (draw(spark, sf_dir).collect() for _ in range(2))
    assert sorted(first) == sorted(again) and 0 < len({r["id"] for r in first}) == len(first)


def test_entry_and_contract(spark):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stands_without_the_corpus_operators(tmp_path):
    """A copy without the subpackage, its tests and the pipeline imports, lists the other queries and passes their tests."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry.__file__).parent
    for folder in ("studylake", "tests"):
        shutil.copytree(root / folder, tmp_path / folder, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin"})
    assert said.returncode == 0, said.stderr
    assert int(said.stdout) == len(registry.QUERIES)
    if "STANDS_ALONE" not in os.environ:
        some = "wrong_questions or contract or ladder or draw_is"
        run = subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "-x", "-p", "no:cacheprovider", "-k", some], cwd=tmp_path, capture_output=True, text=True, timeout=600, env={**os.environ, "STANDS_ALONE": "1"})
        assert run.returncode == 0, run.stdout[-2000:]


def test_a_missing_library_is_an_error(tmp_path):
    """Only the absence of the corpus part itself is passed over."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry.__file__).parent
    shutil.copytree(root / "studylake", tmp_path / "studylake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import a_library_that_is_not_there")
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin"})
    assert said.returncode != 0 and "a_library_that_is_not_there" in said.stderr
