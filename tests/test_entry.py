"""The entry module without what only the corpus operators need."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
BLOCKED = """
import sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] == {name!r} or name == {name!r}:
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Absent())
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
queries, oracles = entry.queries(), entry.oracle_sql()
assert not set(oracles) - set(queries)
print(len([q for q in queries if not q.startswith("op") and q != "pipeline"]), "asset_health" in queries)
"""


@pytest.mark.parametrize("name", ["xxhash", "tokenizers", "zstandard", "pulsegrid.llm", "corpus_pipeline"])
def test_entry_without_an_optional_part(name):
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", BLOCKED.format(name=name, root=ROOT)], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    count, there = done.stdout.split()
    assert int(count) >= 90 and there == "True"
