from __future__ import annotations

import datetime as dt

import pytest
from conftest import by_key, customer, sale
from pyspark.sql import functions as F

from patronage.errors import DataValidationError
from patronage.functions.text import header_name, keyword_category, title_case
from patronage.operators.cleaning import clean_report, clean_strict, cleaning_report
from patronage.operators.loading import upsert
from patronage.operators.profiling import constraint_audit, profile


def feed(spark, columns: list[str], rows: list[tuple]):
    schema = ", ".join(f"`{name}` STRING" for name in columns) + ", sent INT"
    return spark.createDataFrame([(*row, place) for place, row in enumerate(rows)], schema)


def test_last_of_equal_keys_wins(spark):
    rows = feed(spark, [" Customer ID", "Name ", "Age", "GENDER", "Signup Date"], [
        ("1", "  aDITI sharma", "150", "f", "2024-01-01"), ("1", "Aditi Sharma", "30", "Female", "2024-01-02")])
    cleaned = clean_strict(rows, "customers", "sent")
    assert [tuple(row) for row in cleaned.collect()] == [(1, "Aditi Sharma", 30, "Female", dt.date(2024, 1, 2))]
    report = {row.metric: row.value for row in cleaning_report(rows, cleaned, "customers").collect()}
    assert report["duplicates_removed"] == 1 and report["rows_standardized"] == 1 and report["rows_received"] == 2


def test_dirty_customers(spark):
    columns = ["customer_id", "name", "age", "gender", "signup_date", "is_active"]
    rows = feed(spark, columns, [
        ("1", " o'brien mary-jane x2y ", "15", "f", "2024-01-01", "Y"),
        ("2", "b", "16", "M", "2024-01-01", "0"),
        ("3", "c", "110", " non-binary ", "2024-01-01", None),
        ("4", "d", "111", None, "2024-01-01", " TRUE "),
        ("5.0", "e", "old", "x", "2024-01-01 10:00:00", "yes"),
        ("06", "f", "17", "F", "2024-01-01", "1")])
    found = by_key(clean_strict(rows, "customers", "sent"), "customer_id")
    assert sorted(found) == [1, 2, 3, 4, 5, 6]
    assert found[1].name == "O'Brien Mary-Jane X2Y"
    assert [found[n].gender for n in range(1, 7)] == ["Female", "Male", "Non-Binary", None, "X", "Female"]
    assert [found[n].is_active for n in range(1, 7)] == [True, False, False, True, True, True]
    assert [found[n].age for n in range(1, 7)] == [17, 16, 110, 17, 17, 17]  # median of 16, 17 and 110
    assert found[5].signup_date == dt.date(2024, 1, 1)


def test_age_rounds_half_to_even_and_all_unknown_stays_null(spark):
    columns = ["customer_id", "name", "age", "signup_date"]
    half = feed(spark, columns, [("1", "a", "20", "2024-01-01"), ("2", "b", "21", "2024-01-01"),
                                 ("3", "c", "", "2024-01-01")])
    assert by_key(clean_strict(half, "customers", "sent"), "customer_id")[3].age == 20
    unknown = feed(spark, columns, [("1", "a", "x", "2024-01-01")])
    assert clean_strict(unknown, "customers", "sent").first().age is None


def test_dirty_money(spark):
    columns = ["transaction_id", "customer_id", "order_amount", "order_date"]
    rows = feed(spark, columns, [(str(n), "1", text, "2024-01-01 10:11:12")
                                 for n, text in enumerate(["abc", "-5", "", "1e3", None])])
    found = by_key(clean_strict(rows, "transactions", "sent"), "transaction_id")
    assert [found[n].order_amount for n in range(5)] == [0.0, 0.0, 0.0, 1000.0, 0.0]
    loose = by_key(clean_report(rows, "transactions", "sent"), "transaction_id")
    assert [loose[n].order_amount for n in range(5)] == [None, -5.0, None, 1000.0, None]


def test_invalid_required_values(spark):
    columns = ["customer_id", "name", "signup_date"]
    rows = feed(spark, columns, [("1", "a", "soon"), ("2", None, "2024-01-01"), ("3", "c", "2024-01-01")])
    with pytest.raises(DataValidationError, match="Invalid required values: {'name': 1, 'signup_date': 1}"):
        clean_strict(rows, "customers", "sent")
    report = {row.metric: row.value
              for row in cleaning_report(rows, clean_report(rows, "customers", "sent"), "customers").collect()}
    assert (report["invalid_name"], report["invalid_signup_date"], report["missing_values"]) == (1, 1, 2)


def test_unknown_dataset_and_missing_columns(spark):
    rows = feed(spark, ["customer_id"], [("1",)])
    with pytest.raises(DataValidationError, match="Unknown dataset type: people"):
        clean_strict(rows, "people", "sent")
    with pytest.raises(DataValidationError, match="Missing required columns: name, signup_date"):
        clean_strict(rows, "customers", "sent")


def test_other_date_formats(spark):
    rows = feed(spark, ["transaction_id", "customer_id", "order_amount", "order_date"],
                [("1", "1", "1", "12/1/2010 8:26"), ("2", "1", "1", "2010-12-01T08:26:00")])
    found = clean_strict(rows, "transactions", "sent", formats=["M/d/yyyy H:mm"]).collect()
    assert {row.order_date for row in found} == {dt.datetime(2010, 12, 1, 8, 26)}


def test_header_and_title():
    assert header_name("  Signup  Date ") == "signup_date"


def test_title_case_beyond_ascii(spark):
    row = spark.range(1).select(title_case(F.lit("élan vITAL 3rd ça-va")), title_case(F.lit(None).cast("string")),
                                title_case(F.lit(""))).first()
    assert tuple(row) == ("Élan Vital 3Rd Ça-Va", None, "")


def test_keywords(spark):
    texts = ["STEAM IRON", "PEN", "PEN SET", "candle bag", None, "lunch box", "Birthday game"]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    assert [row[0] for row in df.select(keyword_category(F.col("t"))).collect()] == [
        "Kitchen & Dining", "Other", "Stationery", "Home & Living", "Other", "Other", "Seasonal & Gifts"]


def test_profile(spark):
    df = spark.createDataFrame([(n, n > 2, None) for n in (1, 2, 3, 4)], "n INT, yes BOOLEAN, gap DOUBLE")
    found = by_key(profile(df), "column_name")
    n = found["n"]
    assert (n["count"], n["mean"], n["std"], n["min"], n["p25"], n["p50"], n["p75"], n["max"]) == (
        4.0, 2.5, 1.29, 1.0, 1.75, 2.5, 3.25, 4.0)
    assert found["yes"]["mean"] is None and found["gap"]["missing"] == 4 and found["gap"]["p50"] is None
    assert (n["row_count"], n["column_count"], n["duplicate_rows"]) == (4, 3, 0)


def test_profile_counts_null_rows_as_duplicates(spark):
    found = by_key(profile(spark.createDataFrame([(1, None), (1, None)], "a INT, b STRING")), "column_name")
    assert found["b"]["duplicate_rows"] == 1 and found["b"]["missing"] == 2


def test_profile_quartiles_with_a_frequent_value(spark, many_runs):
    import numpy as np

    values = [7.0] * 400 + [float(n * n % 311) for n in range(800)]
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE").repartition(6)
    row = profile(df).first()
    assert [row.p25, row.p50, row.p75] == [round(float(np.percentile(values, p)), 2) for p in (25, 50, 75)]


def test_constraint_audit(make):
    day = dt.datetime(2024, 1, 1)
    tables = make(
        customers=[customer(1, age=15, email="a"), customer(1, email="a"), customer(2, name=None)],
        products=[{"product_id": 1, "product_name": "p", "category": "c", "unit_price": -1.0, "unit_cost": 1.0}],
        transactions=[sale(1, 1, -1.0, day, quantity=0), sale(2, 9, 1.0, day, product_id=7),
                      sale(3, 9, 1.0, day, product_id=None)])
    found = {(row.table_name, row.rule): row.violations for row in constraint_audit(tables).collect()}
    broken = {key: count for key, count in found.items() if count}
    assert broken == {
        ("customers", "age between 16 and 110"): 1, ("customers", "customer_id unique"): 1,
        ("customers", "email unique"): 1, ("customers", "name not null"): 1,
        ("customers", "created_at not null"): 3, ("products", "unit_price >= 0"): 1,
        ("transactions", "quantity > 0"): 1, ("transactions", "order_amount >= 0"): 1,
        ("transactions", "customer_id references"): 2, ("transactions", "product_id references"): 1}


def test_upsert(spark):
    target = spark.createDataFrame([(1, "a", "a@x"), (2, "b", "b@x")], "id INT, name STRING, email STRING")
    without = spark.createDataFrame([(2, "B"), (3, "c")], "id INT, name STRING")
    assert sorted(tuple(r) for r in upsert(target, without, "id", {"email": "none"}).collect()) == [
        (1, "a", "a@x"), (2, "B", "b@x"), (3, "c", "none")]
    empty = spark.createDataFrame([(2, None)], "id INT, email STRING")
    assert sorted(tuple(r) for r in upsert(target, empty, "id").collect()) == [(1, "a", "a@x"), (2, "b", None)]


def test_profile_makes_its_input_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(row):
        made.add(1)
        return row

    rows = spark.createDataFrame([(n, f"t{n}") for n in range(20)], "n INT, t STRING").rdd.map(counted)
    found = by_key(profile(spark.createDataFrame(rows, "n INT, t STRING")), "column_name")
    assert (found["n"]["row_count"], found["n"]["p50"], made.value) == (20, 9.5, 20)


def test_texts_of_plain_letters_take_the_short_way(spark):
    from patronage.functions.text import stripped, title_case

    texts = ["hOT boLT", " two  words ", "", " ", "a", "2ring", "tab\tx", "o'brien mary-jane", "　wide　", "été x",
             "x ", "\x85y", "a\n", "\nb", None]
    df = spark.createDataFrame([(text,) for text in texts], "t STRING")
    found = [tuple(row) for row in df.select(title_case(F.col("t")), stripped(F.col("t"))).collect()]
    assert found == [
        ("Hot Bolt", "hOT boLT"), (" Two  Words ", "two  words"), ("", ""), (" ", ""), ("A", "a"), ("2Ring", "2ring"),
        ("Tab\tX", "tab\tx"), ("O'Brien Mary-Jane", "o'brien mary-jane"), ("　Wide　", "wide"), ("Été X", "été x"),
        ("X ", "x"), ("\x85Y", "y"), ("A\n", "a"), ("\nB", "b"), (None, None)]
    plan = df.select(title_case(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "initcap" in plan.lower()
