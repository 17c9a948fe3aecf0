import importlib

import __spark_entry__ as entry


def test_catalogue_is_consistent():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and "p5_found" in names


def test_core_does_not_import_the_optional_part():
    from pathlib import Path

    root = Path(importlib.import_module("tagloom").__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "tagloom.llm" not in path.read_text(encoding="utf-8")
