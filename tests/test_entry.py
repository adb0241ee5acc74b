"""The entry module is read in a fresh process, before any session exists."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
READ = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), 'pipeline' in q)"


def read(folder):
    done = subprocess.run([sys.executable, "-c", READ], cwd=folder, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(folder)})
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


def test_entry_is_read_without_a_session():
    assert int(read(ROOT)[0]) > 290


def test_entry_is_read_without_the_corpus_operators(tmp_path):
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{ROOT}/tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    n, pipeline = read(tmp_path)
    assert int(n) > 290
    assert pipeline == "False"
