"""The driver's contract still holds when an optional package is missing."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
SCRIPT = """
import sys
class Blocked:
    def find_spec(self, name, path=None, target=None):
        if name == sys.argv[1]:
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Blocked())
sys.path.insert(0, sys.argv[2])
import __spark_entry__ as contract
print(len(contract.catalog.QUERIES), len(contract.queries()), "pipeline" in contract.queries(), len(contract.LLM_MISSING))
"""


@pytest.mark.parametrize("module", ["zstandard", "public_tokenizers", "caselink.llm", "corpus_pipeline"])
def test_case_queries_stay_without_an_optional_module(module):
    done = subprocess.run([sys.executable, "-c", SCRIPT, module, ROOT], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    own, all_queries, pipeline, missing = done.stdout.split()
    assert int(missing) == 1 and pipeline == "False"
    if module != "corpus_pipeline":
        assert own == all_queries
