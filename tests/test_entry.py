"""The entry module with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

from fleetlens.plans import ALL

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sorted(set(e.queries()) & {'pipeline', 'op4_exact_dedup'}))"


@pytest.mark.parametrize("pipeline", [True, False])
@pytest.mark.parametrize("left", ["nothing", "an empty folder"])
def test_the_rest_works_without_the_subpackage(tmp_path, pipeline, left):
    """A copy without both folders, with and without the pipeline's module."""
    copy = tmp_path / "copy"
    copy.mkdir()
    shutil.copytree(f"{ROOT}/fleetlens", copy / "fleetlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py"] + ["corpus_pipeline.py"] * pipeline:
        if os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", copy)
    if left == "an empty folder":
        (copy / "fleetlens" / "llm" / "__pycache__").mkdir(parents=True)
    out = subprocess.run([sys.executable, "-c", LIST], cwd=copy, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(copy)})
    assert out.returncode == 0, out.stderr[-2000:]
    assert out.stdout.split(" ", 1)[0] == str(len(ALL)) and out.stdout.strip().endswith("[]")
