"""The entry module without what the corpus subpackage needs."""

import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("missing", ["sparkbars.llm", "corpus_pipeline", "public_tokenizers", "xxhash"])
def test_engine_queries_survive_a_missing_import(missing):
    code = f"""
import sys
sys.modules[{missing!r}] = None  # importing it raises ImportError
import __spark_entry__ as entry
names = entry.queries()
assert "trades" in names and "pipeline" not in names and not any(n.startswith("op") and n[2].isdigit() for n in names), names.keys()
assert set(entry.oracle_sql()) <= set(names)
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
