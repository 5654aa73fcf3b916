import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_core_does_not_import_llm():
    code = "import sys; sys.modules['bibliome.llm'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any('llm' in m for m in sys.modules if sys.modules[m] is not None and m.startswith('bibliome')))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 60 and int(out[1]) > 60 and out[2] == "False"


def test_no_localcheckpoint_and_no_row_caps_in_sources():
    bad = []
    for base, _, files in os.walk(os.path.join(ROOT, "bibliome")):
        bad += [f for f in files if f.endswith(".py") and "localCheckpoint(" in open(os.path.join(base, f), encoding="utf-8").read()]
    assert not bad


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no driver data")
def test_every_core_query_has_a_stable_schema(spark):
    from bibliome import queries

    for name, f in queries.QUERIES.items():
        df = f(spark, "/root/testdata/sf0.001")
        assert df.columns == f(spark, "/root/testdata/sf0.001").columns, name
        assert all(t != "void" for _, t in df.dtypes), name
