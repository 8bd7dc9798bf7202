"""Database sink."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from patronage.schemas import empty_table

# Children before the tables they refer to, and rows per round trip.
CLEAR_ORDER = ["support", "marketing", "transactions", "products", "customers"]
TABLE_NAMES = {"support": "support_tickets", "marketing": "marketing_activities"}
BATCH_ROWS = {"customers": 10_000, "products": 10_000, "transactions": 25_000}


def load_database(tables: Mapping[str, DataFrame], url: str, properties: Mapping[str, str] | None = None,
                  cascade: bool = True) -> None:
    """Empty all five domain tables, children first, then fill those given, parents first.

    Tables not given are emptied too, since their rows would refer to parents that
    are gone. ``cascade`` lets the database empty a table that others refer to; turn
    it off where the database does not know the word. A failed run leaves tables empty
    or partly filled and is repeated as a whole.
    """
    spark = next(iter(tables.values())).sparkSession
    for name in CLEAR_ORDER:
        empty = tables[name].limit(0) if name in tables else empty_table(spark, name)
        _write(empty, name, url, properties, mode="overwrite", truncate=True, cascadeTruncate=cascade)
    for name in reversed(CLEAR_ORDER):
        if name in tables:
            _write(tables[name], name, url, properties, mode="append", batchsize=BATCH_ROWS.get(name, 10_000))


def _write(df: DataFrame, name: str, url: str, properties, mode: str, **options) -> None:
    df.write.options(**options).jdbc(url, TABLE_NAMES.get(name, name), mode=mode, properties=dict(properties or {}))
