"""The library without the training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

PROBE = """
import sys
import __spark_entry__ as entry
from pagemill.plans import all_oracles, all_queries
assert entry.__file__.startswith(sys.argv[1]), entry.__file__
assert set(entry.queries()) == set(all_queries())
assert set(entry.oracle_sql()) == set(all_oracles())
print(len(entry.queries()))
"""


def test_a_copy_without_the_training_data_operators(tmp_path):
    """Also with ``corpus_pipeline.py`` left behind and with compiled files of the deleted folder."""
    for leave, begin in ((True, "kept"), (False, "gone")):
        copy = tmp_path / begin
        shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "spark-warehouse", *(() if leave else ("corpus_pipeline.py",))))
        (copy / "pagemill" / "llm" / "__pycache__").mkdir(parents=True)  # an empty folder is a package to Python
        found = subprocess.run([sys.executable, "-c", PROBE, str(copy)], cwd=copy, capture_output=True, text=True,
                               env={**os.environ, "PYTHONPATH": str(copy)})
        assert found.returncode == 0, found.stderr
        assert int(found.stdout) > 80
        listed = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=copy, capture_output=True,
                                text=True, env={**os.environ, "PYTHONPATH": str(copy)})
        assert listed.returncode == 0, listed.stdout[-2000:]
