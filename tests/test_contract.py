import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(folder) -> set[str]:
    code = "import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    return set(done.stdout.split())


def test_queries_with_and_without_the_training_data_operators(tmp_path):
    ignored = shutil.ignore_patterns("__pycache__", "llm")
    shutil.copytree(f"{ROOT}/postlake", tmp_path / "postlake", ignore=ignored)
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    found = names(tmp_path)
    assert "stats_folders" in found and not any(n.startswith("op") and n[2].isdigit() for n in found) and "pipeline" not in found
    assert found <= names(ROOT)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
