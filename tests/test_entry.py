"""The registered queries against their SQL, and the entry point without the optional part."""

import subprocess
import sys

import duckdb
import pandas as pd
import pytest

from foliant import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list:
    def plain(v):
        if v is None or (not isinstance(v, (list, dict)) and pd.isna(v)):
            return "None"
        if hasattr(v, "year"):
            return str(v)[:10]
        return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", ["toc_runs_islands", "greedy_boundaries", "segment_items", "furniture_lines", "silent_failure", "calibration", "gap_cut", "suffix_plateau", "sgml_blocks", "sentence_split", "validator_warnings", "metric_table", "bench_summary", "screen_findings", "markdown_terms", "anchor_argmax", "nearest_rank", "stripped_item_view"])
def test_query_equals_sql(spark, con, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    want = con.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_stands_without_the_optional_part():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.split('.')[:2] == ['foliant', 'llm'] or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'segment_items' in e.queries() and not any(n.startswith('op') or n == 'pipeline' for n in e.queries())\n"
        "assert set(e.oracle_sql()) <= set(e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/", 2)[0])
