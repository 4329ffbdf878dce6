"""The driver's contract, with and without the optional parts."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and all(callable(f) for f in entry.queries().values())


def test_without_the_optional_parts(tmp_path):
    shutil.copytree(f"{ROOT}/bytequarry", tmp_path / "bytequarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [k for k in q if k.startswith('op')] and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_a_broken_part_is_an_error(tmp_path):
    """Only a part that has been removed is passed over, not one that can't be imported."""
    (tmp_path / "bytequarry" / "llm").mkdir(parents=True)
    shutil.copytree(f"{ROOT}/bytequarry", tmp_path / "bytequarry", ignore=shutil.ignore_patterns("llm", "__pycache__"), dirs_exist_ok=True)
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    (tmp_path / "bytequarry" / "llm" / "__init__.py").write_text("")
    (tmp_path / "bytequarry" / "llm" / "queries.py").write_text("import bytequarry.llm.missing\n")
    code = "import __spark_entry__ as e\ntry:\n    e.queries()\nexcept ModuleNotFoundError:\n    pass\nelse:\n    raise SystemExit(1)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_no_import_of_the_optional_parts():
    for folder, _, names in os.walk(f"{ROOT}/bytequarry"):
        if "llm" not in folder:
            for n in names:
                if n.endswith(".py"):
                    assert "bytequarry.llm" not in open(os.path.join(folder, n)).read()
