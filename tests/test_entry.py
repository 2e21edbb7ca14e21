"""The driver contract: names, comparison SQL, the library without its optional part."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_names():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) > 120
    assert {f"p{n}_found" for n in (1, 4, 7)} <= set(names)


def test_without_the_optional_part():
    code = "import sys; sys.modules['docassay.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and 'p2_found' not in q; print(len(q))"
    assert int(subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout) > 100


def test_nothing_imports_the_optional_part():
    for path in (ROOT / "docassay").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
