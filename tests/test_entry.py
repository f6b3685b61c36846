import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "detections_by_type" in entry.queries()


def test_flagship(spark):
    out = entry.entry(spark)
    assert out.columns == ["entity_type", "ord", "accepted", "cross_run", "average_confidence"] and out.count() == 9


def test_the_engine_does_not_import_the_corpus_operations():
    code = "import sys, maskwright.cli, maskwright.plans.catalog, maskwright.plans.documents, maskwright.streaming.detection; sys.exit(any(m.startswith('maskwright.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0


def test_the_engine_works_without_the_corpus_operations(tmp_path):
    """In a copy without maskwright/llm and tests/llm, with and without corpus_pipeline.py."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and 'plan_by_type' in q and not [n for n in q if n.startswith('op') or n == 'pipeline']"
    for pipeline in (True, False):
        if not pipeline:
            (copy / "corpus_pipeline.py").unlink(missing_ok=True)
        assert subprocess.run([sys.executable, "-c", code], cwd=copy).returncode == 0
