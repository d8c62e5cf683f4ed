"""The driver's contract, and that nothing needs the subpackage llm."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_and_names(spark):
    df = entry.entry(spark)
    assert df.columns == ["i", "j", "dist"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_llm():
    code = (
        "import sys\n"
        "class No:\n"
        "    def find_spec(self, name, *a):\n"
        "        if name.startswith('twinsift.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name, name='twinsift.llm' if 'llm' in name else name)\n"
        "sys.meta_path.insert(0, No())\n"
        "import __spark_entry__ as e\n"
        "assert len(e.queries()) > 30 and not [n for n in e.queries() if n.startswith('op') or n == 'pipeline']\n"
        "from twinsift import cli, encode, sinks\n"
        "assert not [m for m in sys.modules if m.startswith('twinsift.llm')]\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


QUICK = ["store_shape", "near_dup_pairs", "near_dup_pairs_planted", "near_dup_pairs_compat", "import_matches", "dup_groups", "keep_pic_dir", "update_candidates", "orphans", "split_ext", "caption_chunks"]


@pytest.mark.parametrize("name", QUICK)
def test_sql_gives_the_same_rows(spark, name):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("embeddings", "events", "documents", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = entry.queries()[name](spark, sf)
    want = c.execute(f"SELECT {', '.join(f'"{x}"' for x in got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    tidy = lambda rows: sorted(tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in rows)
    assert tidy(map(tuple, got.collect())) == tidy(want)


@pytest.mark.parametrize("name", ["pairwise_matrix", "near_dup_pairs_intended", "dup_groups_compat", "move_targets", "move_plan_live", "metadata_rows"])
def test_sql_of_the_other_queries(spark, name):
    test_sql_gives_the_same_rows(spark, name)


def test_entry_without_a_package_of_the_subpackage():
    code = "import sys\nsys.modules['zstandard'] = None\nimport __spark_entry__ as e\nassert len(e.queries()) > 30 and 'pipeline' not in e.queries()\n"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
