"""Every query of the library runs, and gives the rows of its SQL."""

from __future__ import annotations

import math

import duckdb
import pandas as pd
import pytest

from quirework.plans.oracles import ORACLES
from quirework.plans.queries import QUERIES

def _rows(frame) -> list[tuple]:
    def one(v: object) -> str:
        if pd.api.types.is_scalar(v) and pd.isna(v):
            return ""
        return f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) and not math.isinf(float(v)) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(map(one, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name not in ORACLES:
        return
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_entry_imports_without_the_subpackage(tmp_path):
    """The driver takes the llm folders and corpus_pipeline.py away."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "quirework", tmp_path / "quirework", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'furniture_exact' in q and not any(n.startswith('op') for n in q); assert set(o) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
