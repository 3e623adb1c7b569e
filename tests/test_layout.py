import re
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_imports_llm():
    users = [p for p in (ROOT / "lodestrata").rglob("*.py") if "llm" not in p.parts and re.search(r"lodestrata\.llm|from \.llm", p.read_text())]
    assert users == []


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and "file_features" in entry.queries()
