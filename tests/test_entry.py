"""The entry module with and without the training-data package."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(folder):
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=120)
    return out


def copied(tmp_path, without=()):
    folder = tmp_path / "repo"
    shutil.copytree(os.path.join(ROOT, "augsight"), folder / "augsight",
                    ignore=shutil.ignore_patterns("__pycache__", *[w for w in without if "/" not in w and not w.endswith(".py")]))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in without and os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), folder / name)
    return folder


@pytest.mark.parametrize("without", [("llm", "corpus_pipeline.py"), ("llm",)])
def test_import_without_training_data_package(tmp_path, without):
    out = names(copied(tmp_path, without=without))
    assert out.returncode == 0, out.stderr
    queries, oracle = (set(line.split()) for line in out.stdout.strip().splitlines()[-2:])
    assert "tfidf" in queries and oracle < queries
    assert not [q for q in queries if q.startswith("op") or q == "pipeline"]


def test_error_inside_the_package_is_not_hidden(tmp_path):
    folder = copied(tmp_path)
    if not (folder / "augsight" / "llm").exists():
        return
    with open(folder / "augsight" / "llm" / "queries.py", "a") as f:
        f.write("\nimport a_module_that_is_not_there\n")
    out = names(folder)
    assert out.returncode != 0 and "a_module_that_is_not_there" in out.stderr
