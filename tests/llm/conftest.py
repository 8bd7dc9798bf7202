from __future__ import annotations

import pytest

from patronage.llm.queries import ship

#: Columns that operators use inside, or give out, themselves.
CLASHING = ["n_words", "rep", "copies", "size", "kept", "ids", "key", "component_id", "start", "host", "bands", "_copy"]


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def documents(spark):
    """A table of documents with clashing extra columns; rows are (doc_id, text) or (doc_id, text, source)."""

    def table(rows: list[tuple], partitions: int = 3):
        full = [(row[0], row[1], None, row[2] if len(row) > 2 else "s", len(row[1]) if row[1] is not None else None,
                 *["x"] * len(CLASHING)) for row in rows]
        kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
            f"`{name}` string" for name in CLASHING)
        return spark.createDataFrame(full, kinds).repartition(partitions)

    return table
