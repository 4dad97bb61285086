import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SAYS = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), set(o) <= set(q), sum(n.startswith('op') or n == 'pipeline' for n in q))"


def told(folder) -> list[str]:
    out = subprocess.run([sys.executable, "-W", "ignore", "-c", SAYS], cwd=folder, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return out.stdout.split()


def test_entry_without_the_corpus_operators(tmp_path):
    for left_out in ([], ["corpus_pipeline.py"], ["llm"], ["corpus_pipeline.py", "llm"]):
        folder = tmp_path / ("without-" + "-".join(left_out))
        shutil.copytree(ROOT, folder, ignore=shutil.ignore_patterns(".git", "tests", "__pycache__", *left_out))
        n, twins_known, corpus = told(folder)
        assert int(n) > 140 and twins_known == "True"
        assert (int(corpus) == 0) == ("llm" in left_out)
