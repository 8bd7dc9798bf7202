"""Profile of a table and audit of the rules its data must keep."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronage.functions.numbers import EXACT, rounded
from patronage.operators.selection import extent, ranked_values
from patronage.schemas import Tables
from patronage.session import at_once, staged

QUARTILES = {"p25": 1, "p50": 2, "p75": 3}
NUMERIC = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]


def profile(df: DataFrame) -> DataFrame:
    """One row per column: type, missing values and, for numbers, a summary; plus table totals.

    Quartiles interpolate between the exact neighbours, which are selected by
    narrowing histograms. The table is stored once, as what it is made from may be
    joins: it is read for the totals, for the digests of its rows, and in every round
    of the selection.
    """
    df = staged(df, "profiled")
    numeric = [field.name for field in df.schema.fields if isinstance(field.dataType, T.NumericType)]
    totals = []
    for name in df.columns:
        totals.append(F.count_if(F.col(name).isNull()).alias(f"missing {name}"))
        if name in numeric:
            value = F.col(name).cast("double")
            totals += [F.count(name).alias(f"count {name}"),
                       F.try_divide(F.sum(F.col(name).cast(EXACT)).cast("double"), F.count(name))
                       .alias(f"mean {name}"),
                       F.stddev_samp(value).alias(f"std {name}"), F.min(value).alias(f"min {name}"),
                       F.max(value).alias(f"max {name}")]
    summary, repeats = at_once([lambda: df.agg(F.count("*").alias("row_count"), *totals, *extent(numeric)).first(),
                                lambda: duplicate_rows(df)])
    quartiles = exact_quartiles(df, numeric, summary)

    def entry(field: T.StructField) -> tuple:
        def stat(metric: str) -> float | None:
            if field.name not in numeric:
                return None
            found = quartiles[field.name][metric] if metric in QUARTILES else summary[f"{metric} {field.name}"]
            return None if found is None else float(found)

        return (summary["row_count"], len(df.columns), repeats, field.name, field.dataType.simpleString(),
                summary[f"missing {field.name}"], *map(stat, NUMERIC))

    schema = ("row_count long, column_count int, duplicate_rows long, column_name string, data_type string, missing long, "
              + ", ".join(f"{metric} double" for metric in NUMERIC))
    rows = df.sparkSession.createDataFrame([entry(field) for field in df.schema.fields], schema)  # one per column
    return rows.withColumns({metric: rounded(F.col(metric), 2) for metric in NUMERIC})


def duplicate_rows(df: DataFrame) -> int:
    """Rows less different rows.

    Rows are told apart by two 64-bit digests of their cells; only those whose digests
    occur again are compared cell by cell.
    """
    places = [F.lit(str(i)) for i in range(len(df.columns))]
    # digests pass over nulls, so which cells are null is digested as well
    nulls = F.concat_ws(",", *[F.when(F.col(f"`{name}`").isNull(), place)
                               for name, place in zip(df.columns, places, strict=True)])
    cells = [F.col(f"`{name}`") for name in df.columns]
    digests = [F.xxhash64(F.lit(seed), nulls, *cells).alias(f"_digest{seed}") for seed in range(2)]
    counted = df.select(*digests).groupBy("_digest0", "_digest1").agg(F.count("*").alias("n")).filter("n > 1")
    again = staged(counted, "digests")
    rows = again.agg(F.sum("n").alias("n")).first()["n"]
    if not rows:
        return 0
    digested = df.select("*", *digests)
    same = digested.join(again.drop("n"), ["_digest0", "_digest1"], "left_semi").select(*cells).distinct().count()
    return rows - same


def exact_quartiles(df: DataFrame, columns: list[str], known: Row | None = None) -> dict[str, dict[str, float | None]]:
    """Linearly interpolated quartiles of several columns at once."""
    def neighbours(n: int) -> list[int]:
        below = [(n - 1) * part // 4 for part in QUARTILES.values()] if n else []
        return [rank for low in below for rank in (low, min(low + 1, n - 1))]

    picked = ranked_values(df, columns, neighbours, known)
    result: dict[str, dict[str, float | None]] = {}
    for name, found in picked.items():
        result[name] = {}
        for metric, part in QUARTILES.items():
            if not found.size:
                result[name][metric] = None
                continue
            low, rest = divmod((found.size - 1) * part, 4)
            below = found.values[low]
            above = found.values[min(low + 1, found.size - 1)]
            result[name][metric] = below + (above - below) * rest / 4
    return result


class Checks(NamedTuple):
    """What the rows of a table must keep."""

    broken: dict[str, Column]  # by rule, what holds for a row that breaks it
    unique: Sequence[str] = ()
    references: Mapping[str, str] = {}  # column to the table whose first unique column it names


def present(*names: str) -> dict[str, Column]:
    return {f"{name} not null": F.col(name).isNull() for name in names}


def constraint_audit(tables: Tables) -> DataFrame:
    """Violations per table and rule: missing values, ranges, unique keys and references."""
    return audit(tables._asdict(), {
        "customers": Checks({**present("customer_id", "name", "signup_date", "is_active", "created_at"),
                             "age between 16 and 110": ~F.col("age").between(16, 110)}, ["customer_id", "email"]),
        "products": Checks({**present("product_id", "product_name", "category", "unit_price", "unit_cost"),
                            "unit_price >= 0": F.col("unit_price") < 0, "unit_cost >= 0": F.col("unit_cost") < 0},
                           ["product_id"]),
        "transactions": Checks({**present("transaction_id", "customer_id", "quantity", "order_amount", "cost_amount",
                                          "discount_amount", "order_date", "status"),
                                "quantity > 0": F.col("quantity") <= 0, "order_amount >= 0": F.col("order_amount") < 0},
                               ["transaction_id"], {"customer_id": "customers", "product_id": "products"}),
        "marketing": Checks(present("campaign_id", "customer_id", "campaign_response", "campaign_cost", "touched_at"),
                            ["campaign_id"], {"customer_id": "customers"}),
        "support": Checks(present("ticket_id", "customer_id", "ticket_status", "opened_at"), ["ticket_id"],
                          {"customer_id": "customers"}),
    })


def audit(tables: Mapping[str, DataFrame], checks: Mapping[str, Checks]) -> DataFrame:
    """table_name, rule and violations, from one pass over every table and one shuffle.

    Every row gives an entry per key it holds and per rule it breaks. Keys of a table and
    references to them share a domain, so counting the entries of a domain and key tells
    both whether the key is unique and which references to it lead nowhere, without a
    join. Entries are counted before the shuffle, so a key that a third of the rows
    refer to is a row per task. Null keys are neither repeated nor orphans.
    """
    domains: dict[tuple[str, str], int] = {}
    listed: list[tuple[int, str, str, str]] = []  # domain, measure, table, rule
    slots: dict[str, int] = {}  # references to a table, in the order in which they are named

    def domain(table: str, what: str) -> int:
        return domains.setdefault((table, what), len(domains))

    entries = {name: [] for name in checks}

    def entry(number: int, slot: int, holds: Column, key: Column | None = None, whole: bool = True) -> Column:
        none = F.lit(None)
        return F.when(holds, F.struct(F.lit(number).alias("domain"), F.lit(slot).alias("slot"),
                                      (none if key is None or not whole else key).cast("long").alias("key"),
                                      (none if key is None or whole else key).cast("string").alias("text")))

    for name, check in checks.items():
        for rule, breaks in check.broken.items():
            entries[name].append(entry(domain(name, rule), 0, breaks))
            listed.append((domain(name, rule), "rows", name, rule))
        for column in check.unique:
            whole = isinstance(tables[name].schema[column].dataType, T.IntegralType)
            entries[name].append(entry(domain(name, column), 0, F.col(column).isNotNull(), F.col(column), whole))
            listed.append((domain(name, column), "repeated", name, f"{column} unique"))
        for column, parent in check.references.items():
            key = checks[parent].unique[0]
            whole = isinstance(tables[parent].schema[key].dataType, T.IntegralType)
            slots[parent] = slot = slots.get(parent, 0) + 1
            entries[name].append(entry(domain(parent, key), slot, F.col(column).isNotNull(), F.col(column), whole))
            listed.append((domain(parent, key), f"orphans{slot}", name, f"{column} references"))

    most = max(slots.values(), default=0)
    told = reduce(DataFrame.unionByName, [
        tables[name].select(F.explode(F.array_compact(F.array(*own))).alias("e")).select("e.*")
        for name, own in entries.items() if own])
    keys = told.groupBy("domain", "key", "text").agg(
        F.count_if(F.col("slot") == 0).alias("own"),
        *[F.count_if(F.col("slot") == slot).alias(f"from{slot}") for slot in range(1, most + 1)])
    sums = keys.groupBy("domain").agg(
        F.sum("own").alias("rows"), F.sum(F.greatest(F.col("own") - 1, F.lit(0))).alias("repeated"),
        *[F.sum(F.when(F.col("own") == 0, F.col(f"from{slot}"))).alias(f"orphans{slot}") for slot in range(1, most + 1)])
    measures = ["rows", "repeated", *[f"orphans{slot}" for slot in range(1, most + 1)]]
    rules = told.sparkSession.createDataFrame(listed, "domain int, measure string, table_name string, rule string")
    violations = F.coalesce(*[F.when(F.col("measure") == name, F.col(f"`{name}`")) for name in measures], F.lit(0))
    return rules.join(F.broadcast(sums), "domain", "left").select(  # a row per rule
        "table_name", "rule", violations.cast("long").alias("violations"))
