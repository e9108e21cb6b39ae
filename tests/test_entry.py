"""The driver's contract holds with and without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent
ASK = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), any(n.startswith('op') and n[2].isdigit() for n in q))"


def ask(folder):
    done = subprocess.run([sys.executable, "-B", "-c", ASK], cwd=folder, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout.split()[-2:]


def test_queries_have_their_names():
    assert int(ask(REPO)[0]) > 180


def test_without_the_corpus_operators(tmp_path):
    for name in ("meridia", "__spark_entry__.py"):
        src = REPO / name
        if src.is_dir():
            shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(src, tmp_path / name)
    n, corpus = ask(tmp_path)
    assert int(n) > 180 and corpus == "False"
