"""The engine's own queries don't need what only the pipeline operations need."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
BLOCKED = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == sys.argv[1] or name.startswith(sys.argv[1] + "."):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "hybrid_search" in e.queries() and "hybrid_search" in e.oracle_sql()
assert not any(n.startswith("op") or n == "pipeline" for n in e.queries())
"""


@pytest.mark.parametrize("module", ["xxhash", "ahocorasick", "public_tokenizers", "corvane.llm", "corpus_pipeline"])
def test_queries_without(module):
    subprocess.run([sys.executable, "-W", "ignore", "-c", BLOCKED, module], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}, check=True, timeout=120)
