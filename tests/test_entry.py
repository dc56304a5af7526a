import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).parent.parent


def test_entry_stands_without_the_optional_part(tmp_path):
    """What is left without the llm folders and the pipeline still imports and lists its queries."""
    shutil.copytree(REPO / "quillmesh", tmp_path / "quillmesh", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 60 and set(s) <= set(q) and not [n for n in q if n.startswith('op') or n == 'pipeline']"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True)


def test_nothing_else_imports_it():
    for p in (REPO / "quillmesh").rglob("*.py"):
        if "llm" not in p.relative_to(REPO).parts:
            assert "quillmesh.llm" not in p.read_text(), p


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["state", "name", "score", "hops", "chains"]
