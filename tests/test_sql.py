"""Every query against its SQL in an independent engine, on the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_queries_equal_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from quillrank import registry

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    sql = registry.oracle_sql()
    assert set(registry.queries()) - set(sql) == {"pack_batches"}
    wrong = []
    for name, query in registry.queries().items():
        got = query(spark, SF).toPandas()
        if name not in sql:
            assert len(got)
            continue
        expect = con.execute(sql[name]).fetchdf()
        columns = sorted(got.columns)
        assert columns == sorted(expect.columns), name
        flat = lambda d: sorted(map(str, d[columns].astype(object).where(d[columns].notna(), None).values.tolist()))
        if flat(got) != flat(expect):
            wrong.append(name)
    assert not wrong


def test_entry_module_works_without_the_optional_parts():
    import subprocess
    import sys

    code = ("import sys, importlib.abc\n"
            "class No(importlib.abc.MetaPathFinder):\n"
            "    def find_spec(self, name, path, target=None):\n"
            "        if name == 'quillrank.llm' or name.startswith('quillrank.llm.') or name == 'corpus_pipeline':\n"
            "            raise ModuleNotFoundError(f'No module named {name!r}', name=name)\n"
            "sys.meta_path.insert(0, No())\n"
            "import __spark_entry__ as e\n"
            "assert 'bm25_topk' in e.queries() and not any(q.startswith('op') for q in e.queries()), e.queries()\n"
            "assert set(e.oracle_sql()) <= set(e.queries())\n")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120).returncode == 0
