"""Every registered query outside the training-data operators runs, and equals its SQL where it has one."""

import pytest

from folioscope.plans import catalogue
from tests.compare import connect, rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    assert len(got.columns) == len(set(got.columns))
    sql = catalogue.oracle_sql().get(name)
    if sql is not None:
        want = con.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(5).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_training_data_operators(tmp_path):
    """Without the llm subpackage and the pipeline the rest still imports."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).resolve().parent.parent
    shutil.copytree(repo / "folioscope", tmp_path / "folioscope", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.stdout.split() == [str(len(catalogue.queries())), "False"], done.stderr


def test_fusion_of_every_query(spark):
    from folioscope.operators import search

    rows = [("w", 0, 5, 1), ("w", 0, 6, 2), ("d", 0, 6, 1), ("w", 100, 5, 1), ("d", 100, 7, 2), ("d", 200, 8, 1)]
    found = search.fuse(spark.createDataFrame(rows, "channel string, q long, doc long, rank int"), ["doc"], top=1, query=["q"])
    assert sorted((r.q, r.doc, r.n_channels, r["rank"]) for r in found.collect()) == [(0, 6, 2, 1), (100, 5, 1, 1), (200, 8, 1, 1)]
    asked = {r.query_id for r in catalogue.queries()["rrf_fusion_by_query"](spark, SF).select("query_id").distinct().collect()}
    ids = [f"SELECT {c} FROM '{SF}/{t}.parquet' WHERE {c} % 100 = 0" for t, c in (("benchmark", "item_id"), ("embeddings", "vec_id"))]
    assert asked == {r[0] for r in connect(SF).execute(" UNION ".join(ids)).fetchall()}


def test_entry_with_the_pipeline_but_without_its_operators(tmp_path):
    """The pipeline's file alone doesn't keep the rest from importing."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).resolve().parent.parent
    if not (repo / "corpus_pipeline.py").exists():
        pytest.skip("no pipeline here")
    shutil.copytree(repo / "folioscope", tmp_path / "folioscope", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(repo / name, tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.stdout.split() == [str(len(catalogue.queries())), "False"], done.stderr
