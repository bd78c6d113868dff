"""The driver's entry works with and without the corpus operators."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry

HERE = os.path.dirname(os.path.abspath(entry.__file__))
SAY = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), 'flagship' in q, 'pipeline' in q, any(n.startswith('op') for n in q))"


def copy(tmp_path, *gone):
    def left_out(folder, names):
        at = os.path.relpath(folder, HERE)
        return [n for n in names if n in (".git", "__pycache__") or os.path.normpath(os.path.join(at, n)) in gone]

    shutil.copytree(HERE, tmp_path / "repo", ignore=left_out)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SAY], cwd=tmp_path / "repo", env=env, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    return out.stdout.split()


@pytest.mark.parametrize("pipeline", [[], ["corpus_pipeline.py"]])
def test_without_the_corpus_operators(tmp_path, pipeline):
    n, m, *said = copy(tmp_path, "drivescore/llm", "tests/llm", *pipeline)
    assert int(n) > 100 and int(m) > 100 and said == ["True", "False", "False"]


def test_nothing_else_imports_them():
    for folder, _, names in os.walk(os.path.join(HERE, "drivescore")):
        if os.path.basename(folder) not in ("llm", "__pycache__"):
            for n in names:
                assert not n.endswith(".py") or "llm" not in open(os.path.join(folder, n)).read(), n


def test_names_of_sql_are_names_of_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
