import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def test_rest_works_without_llm(tmp_path):
    """The entry module and its other queries don't need the llm package."""
    import shutil

    shutil.copytree(ROOT / "mnemora", tmp_path / "mnemora", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert not [n for n in e.queries() if n.startswith('op1')]; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


@pytest.mark.parametrize("name", ["recall_hybrid_weighted", "recall_renormalised", "recall_lexical_corpus", "recall_expand_deep", "recall_mmr", "recall_pack", "conflicts_all_pairs", "merge_links", "archive_import", "state_at_undo", "undo_links", "neighbors", "fn_importance"])
def test_against_duckdb(spark, name):
    duckdb = pytest.importorskip("duckdb")
    data = Path("/root/testdata/sf0.001")
    if not data.exists():
        pytest.skip("no test data")
    import __spark_entry__ as e

    con = duckdb.connect()
    for p in data.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = e.queries()[name](spark, str(data))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({e.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_every_oracle_has_its_query_and_no_query_is_another():
    import __spark_entry__ as e

    queries = e.queries()
    assert set(e.oracle_sql()) <= set(queries) and len({id(f) for f in queries.values()}) == len(queries)
