"""The driver's functions: every query is there, and an import that fails leaves the rest working."""

import importlib
import logging
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).resolve().parent


def test_names_of_queries_and_their_sql():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 200
    if (ROOT / "meterlake" / "llm").exists():
        assert {*(f"op{n}" for n in range(1, 14)), "pipeline"} == {n.split("_")[0] for n in queries if n == "pipeline" or n[:2] == "op" and n[2].isdigit()}


def test_operators_that_fail_to_import_are_reported(monkeypatch, caplog):
    monkeypatch.setitem(sys.modules, "meterlake.llm.queries", None)
    monkeypatch.delattr("meterlake.llm.queries", raising=False)
    try:
        with caplog.at_level(logging.ERROR):
            importlib.reload(entry)
        assert len(entry.queries()) >= 200 and "pipeline" not in entry.queries()
        assert bool(caplog.records) == (ROOT / "meterlake" / "llm").exists()
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
