"""The driver's entry points, with and without the training-data operators."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent
BLOCK = "import sys; sys.modules['barloom.llm'] = None; sys.modules['corpus_pipeline'] = None\n"


def ask(code: str) -> str:
    return subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, check=True).stdout


def test_entry_without_llm():
    assert ask(BLOCK + "import __spark_entry__ as e; print([n for n in e.queries() if n.startswith('op') or n == 'pipeline'], len(e.queries()) > 50, set(e.oracle_sql()) <= set(e.queries()))").strip() == "[] True True"


def test_nothing_else_imports_llm():
    for path in (REPO / "barloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert "barloom.llm" not in path.read_text()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
