"""The driver's entry, with the corpus operators and without them."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sorted(n for n in e.queries() if n[:2] == 'op' and n[2:3].isdigit() or n == 'pipeline'))"


def ask(root):
    out = subprocess.run([sys.executable, "-c", ASK], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
    total, sql, corpus = out.stdout.strip().splitlines()[-1].split(" ", 2)
    return int(total), int(sql), corpus


def copy(target, *without):
    shutil.copytree(ROOT, target, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.md", "*.txt", "*.json"))
    for name in without:
        path = os.path.join(target, name)
        (shutil.rmtree if os.path.isdir(path) else os.remove)(path) if os.path.exists(path) else None


def test_entry_without_the_corpus_operators(tmp_path):
    total, sql, corpus = ask(ROOT)
    for k, gone in enumerate((("ridgeline/llm", "tests/llm"), ("ridgeline/llm", "tests/llm", "corpus_pipeline.py"))):
        copy(tmp_path / str(k), *gone)
        left, left_sql, none = ask(tmp_path / str(k))
        assert none == "[]" and left > 100 and left_sql > 100
        assert corpus == "[]" or left == total - corpus.count(",") - 1
    copy(tmp_path / "no-pipeline", "corpus_pipeline.py")
    assert ask(tmp_path / "no-pipeline")[0] in (total, total - 1)


def test_nothing_else_imports_the_corpus_operators():
    for folder, _, names in os.walk(os.path.join(ROOT, "ridgeline")):
        if os.sep + "llm" in folder:
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as source:
                    assert "ridgeline.llm" not in source.read(), name
