import re
from pathlib import Path

import __spark_entry__ as entry

REPO = Path(__file__).resolve().parents[1]


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p3_found", "top_hubs"} <= set(entry.queries())


def test_nothing_outside_imports_the_training_data_package():
    for path in (REPO / "tessera").rglob("*.py"):
        if "llm" not in path.relative_to(REPO).parts:
            assert not re.search(r"(from|import) +tessera\.llm", path.read_text()), path
