"""The driver's contract, with and without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
ASK = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), len(s), sum(k.startswith('op') and k[2].isdigit() for k in q), 'pipeline' in q)"


def asked(root) -> list[str]:
    return subprocess.run([sys.executable, "-c", ASK], cwd=root, capture_output=True, text=True, check=True).stdout.split()


def test_rest_works_without_the_subpackage(tmp_path):
    from loomgrid import queries as engine

    for keep_pipeline in (True, False):
        root = tmp_path / str(keep_pipeline)
        shutil.copytree(ROOT, root, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *[] if keep_pipeline else ["corpus_pipeline.py"]))
        assert not (root / "loomgrid" / "llm").exists()
        assert asked(root) == [str(len(engine.queries())), str(len(engine.oracle_sql())), "0", "False"]


def test_oracles_belong_to_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
