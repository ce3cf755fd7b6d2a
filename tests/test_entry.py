"""The contract: names, SQL for known queries, and the library without its llm subpackage."""

import ast
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_registry():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert "threshold_ge" in queries and len(queries) > 90
    assert set(sql) <= set(queries)


def test_stands_without_llm():
    """With the subpackage and the pipeline hidden, the entry still imports and has the other queries."""
    code = """
import sys
class Hide:
    def find_spec(self, name, path=None, target=None):
        if name == 'corpus_pipeline' or name.startswith('vigilake.llm'):
            raise ModuleNotFoundError(f'No module named {name!r}', name=name)
sys.meta_path.insert(0, Hide())
import __spark_entry__ as e
q = e.queries()
assert 'threshold_ge' in q and not any(k.startswith('op') or k == 'pipeline' for k in q if k[2:3].isdigit() or k == 'pipeline'), list(q)
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_imports_llm():
    for path in (ROOT / "vigilake").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            name = getattr(node, "module", None) or ""
            assert "llm" not in name.split("."), path
