"""The training-data subpackage can be taken away."""

import os
import re
import subprocess
import sys

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_nothing_else_imports_llm():
    for folder, _, names in os.walk(os.path.join(TOP, "shapeloom")):
        for name in names:
            if name.endswith(".py") and os.path.basename(folder) != "llm":
                text = open(os.path.join(folder, name), encoding="utf-8").read()
                assert not re.search(r"(import|from)[^\n]*\bllm\b|corpus_pipeline", text), name


def test_entry_without_llm(tmp_path):
    for x in ("__spark_entry__.py", "shapeloom"):
        subprocess.run(["cp", "-r", os.path.join(TOP, x), tmp_path], check=True)
    subprocess.run(["rm", "-rf", tmp_path / "shapeloom" / "llm"], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q) and not any(k.startswith('op') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_other_tests_without_llm(tmp_path):
    """With the folders and the pipeline taken away the remaining tests are all collected, so nothing of theirs imports them."""
    for x in ("__spark_entry__.py", "shapeloom", "tests", "bench.py"):
        subprocess.run(["cp", "-r", os.path.join(TOP, x), tmp_path], check=True)
    subprocess.run(["rm", "-rf", tmp_path / "shapeloom" / "llm", tmp_path / "tests" / "llm"], check=True)
    done = subprocess.run([sys.executable, "-m", "pytest", "-q", "--collect-only", "tests"], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stdout[-500:]
