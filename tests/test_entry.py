"""The entry module with and without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SHOW = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); assert set(s) <= set(q); print(len(q), 'pipeline' in q, any(n.startswith('op1_') for n in q))"


def shown(folder):
    return subprocess.run([sys.executable, "-c", SHOW], cwd=folder, capture_output=True, text=True, check=True).stdout.split()[-3:]


def test_whole():
    number, *rest = shown(ROOT)
    assert int(number) > 60 and len(rest) == 2


def test_without_the_optional_parts(tmp_path):
    shutil.copytree(ROOT / "provenant", tmp_path / "provenant", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    number, pipeline, first = shown(tmp_path)
    assert int(number) > 60 and (pipeline, first) == ("False", "False")


def test_a_broken_optional_part_is_not_hidden(tmp_path):
    shutil.copytree(ROOT / "provenant", tmp_path / "provenant", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "provenant/llm").mkdir()
    (tmp_path / "provenant/llm/__init__.py").touch()
    (tmp_path / "provenant/llm/queries.py").write_text("import no_such_module_at_all\n")
    assert subprocess.run([sys.executable, "-c", SHOW], cwd=tmp_path, capture_output=True, check=False).returncode != 0


def test_smoke(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_the_other_tests_import_without_the_optional_parts(tmp_path):
    shutil.copytree(ROOT / "provenant", tmp_path / "provenant", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(ROOT / "tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(ROOT / name, tmp_path)
    found = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=tmp_path, capture_output=True, text=True, check=False)
    assert found.returncode == 0, found.stdout[-2000:]
