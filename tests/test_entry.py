"""The driver contract holds without the corpus subpackage, and errors inside it are not hidden."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
BLOCK = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()), any(k.startswith("op") for k in e.queries()))
"""


def run(name):
    return subprocess.run([sys.executable, "-B", "-c", BLOCK.format(name=name)], cwd=ROOT, capture_output=True, text=True)


def test_entry_without_the_corpus_subpackage():
    from fairlead import catalog

    for name in ("fairlead.llm", "fairlead.llm.registry"):
        out = run(name)
        assert out.stdout.split() == [str(len(catalog.QUERIES)), str(len(catalog.ORACLE_SQL)), "False"], out.stderr


def test_other_missing_modules_are_errors():
    assert run("fairlead.operators.spatial").returncode != 0
