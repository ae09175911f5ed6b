"""The entry without the optional parts."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
NAMES = "import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"


@pytest.mark.parametrize("pipeline", [True, False])
def test_it_imports_without_the_text_operators(tmp_path, pipeline):
    skip = shutil.ignore_patterns("llm", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"]))
    for name in ("wavecohort", "catalog"):
        shutil.copytree(os.path.join(ROOT, name), tmp_path / name, ignore=skip)
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(os.path.join(ROOT, name)) and (pipeline or name != "corpus_pipeline.py"):
            shutil.copy(os.path.join(ROOT, name), tmp_path)
    out = subprocess.run([sys.executable, "-c", NAMES], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""})
    assert out.returncode == 0, out.stderr
    names = out.stdout.split()
    assert len(names) > 100 and "pipeline" not in names and not [n for n in names if n.startswith("op")]


def test_other_missing_modules_are_errors(tmp_path):
    for name in ("catalog", "wavecohort"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "__init__.py").write_text("registry = None")
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    (tmp_path / "catalog" / "registry.py").write_text("")
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module")
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode != 0 and "no_such_module" in out.stderr
