import importlib


def test_entry_smoke(spark):
    e = importlib.import_module("__spark_entry__")
    df = e.entry(spark)
    rows = df.collect()
    assert len(rows) == 7
    assert df.columns == ["row_no", "label", "precision", "recall", "f1", "support"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    """A copy without stancekit/llm, with and without the pipeline's file."""
    import os
    import shutil
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    check = ("import __spark_entry__ as e; q = e.queries(); assert 'classification_report' in q and 'pipeline' not in q; "
             "assert not [k for k in q if k.startswith('op') and k[2].isdigit()]; assert set(e.oracle_sql()) <= set(q)")
    copy = tmp_path / "repo"
    shutil.copytree(os.path.join(root, "stancekit"), copy / "stancekit", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(os.path.join(root, name)):
            shutil.copy(os.path.join(root, name), copy / name)
    subprocess.run([sys.executable, "-c", check], cwd=copy, check=True, env=os.environ | {"PYTHONPATH": str(copy)})
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    subprocess.run([sys.executable, "-c", check], cwd=copy, check=True, env=os.environ | {"PYTHONPATH": str(copy)})
