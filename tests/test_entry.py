import subprocess
import sys

from tests.conftest import ROOT


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["doc_id", "queue_index", "source_index", "page", "text"]
    assert df.limit(1).count() == 1


def test_every_oracle_belongs_to_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_training_data_subpackage(tmp_path):
    import shutil

    shutil.copytree(f"{ROOT}/parsefold", tmp_path / "parsefold", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and 'pipeline' not in q and not any(x.startswith('op') for x in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ":".join(p for p in sys.path if p and ROOT not in p)})


def test_a_library_that_is_lacking_costs_its_queries_alone(tmp_path):
    code = "import sys; sys.modules['sentencepiece'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and 'pipeline' not in q and not any(x.startswith('op') for x in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=ROOT, check=True)


def test_core_tests_need_neither_folder(tmp_path):
    """The core's tests are found, and some run, in a copy without both llm folders."""
    import shutil

    for name in ("parsefold", "tests"):
        shutil.copytree(f"{ROOT}/{name}", tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    env = {"PATH": __import__("os").environ["PATH"], "HOME": str(tmp_path), "PYTHONPATH": ":".join(p for p in sys.path if p and ROOT not in p)}
    run = lambda *a: subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", *a], cwd=tmp_path, env=env, check=True, capture_output=True, text=True).stdout
    assert "error" not in run("--collect-only", "tests").lower().splitlines()[-1]
    run("tests/test_entry.py::test_every_oracle_belongs_to_a_query", "tests/test_player.py::test_seek_and_natural_end")
