import re
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).parent.parent


def test_registry():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and {"p3_found", "p4_found", "p7_found"} <= set(q)


def test_core_does_not_import_the_llm_package():
    for p in ROOT.rglob("*.py"):
        if "llm" not in p.parts and p.name not in ("__spark_entry__.py", "test_entry.py"):
            assert not re.search(r"linklake\.llm|from linklake import llm", p.read_text()), p


def test_core_works_without_the_llm_package(monkeypatch):
    monkeypatch.setitem(sys.modules, "linklake.llm", None)
    assert "p3_found" in entry.queries() and "p2_found" not in entry.queries()
