from __future__ import annotations

import random

import pytest
from conftest import by_key
from pyspark.sql import functions as F

from patronage.operators import rollups
from patronage.operators.ranking import global_dense_rank, global_row_number, rows_at_ranks, sorted_runs
from patronage.operators.segments import rfm_segments
from patronage.operators.value import (
    action_queue,
    churn_scores,
    health,
    lifetime_value,
    lifetime_value_ranked,
    next_best_actions,
    with_risk_level,
)

RFM = "customer_id BIGINT, recency_days INT, order_count BIGINT, total_revenue DOUBLE"


def expected_quarters(values: list, count: int) -> list[int]:
    """Quartile by position, as cutting ranks 1..n into four equal ranges does."""
    order = sorted(range(count), key=lambda place: (values[place], place))
    quarters = [0] * count
    for position, place in enumerate(order):
        quarters[place] = max(1, -(-4 * position // (count - 1)))
    return quarters


@pytest.mark.parametrize("n", [4, 6, 7, 10, 37])
def test_quartiles_with_ties_and_a_non_buyer(spark, many_runs, n):
    draw = random.Random(n)
    rows = [(i, draw.randint(0, 3), draw.randint(1, 2), float(draw.randint(1, 3))) for i in range(n)]
    scored = by_key(rfm_segments(spark.createDataFrame([*rows, (n, 9999, 0, 0.0)], RFM)), "customer_id")
    for column, place, flip in (("r_score", 1, True), ("f_score", 2, False), ("m_score", 3, False)):
        quarters = expected_quarters([row[place] for row in rows], n)
        assert [scored[i][column] for i in range(n)] == [5 - q if flip else q for q in quarters]
    assert scored[n]["rfm_score"] == 3 and scored[n]["segment"] == "At-Risk"


def test_fewer_than_four_buyers_all_score_one(spark):
    scored = rfm_segments(spark.createDataFrame([(i, i, i, float(i)) for i in range(1, 4)], RFM))
    assert {(row.rfm_score, row.segment) for row in scored.collect()} == {(3, "At-Risk")}


def test_row_order_does_not_matter(spark):
    rows = [(i, i % 3, 1 + i % 2, float(i % 5)) for i in range(23)]
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    first = rfm_segments(spark.createDataFrame(rows, RFM).repartition(5)).collect()
    second = rfm_segments(spark.createDataFrame(shuffled, RFM).repartition(3)).collect()
    assert sorted(first) == sorted(second)


def test_segment_edges(spark):
    from patronage.functions.numbers import band
    from patronage.operators.segments import SEGMENT_BANDS

    found = spark.range(3, 13).select("id", band(F.col("id"), SEGMENT_BANDS).alias("s")).collect()
    assert {row.id: row.s for row in found} == {
        3: "At-Risk", 4: "At-Risk", 5: "Silver", 6: "Silver", 7: "Silver", 8: "Gold", 9: "Gold", 10: "Platinum",
        11: "Platinum", 12: "Platinum"}


VALUE = "customer_id BIGINT, name STRING, order_count BIGINT, average_order_value DOUBLE, purchase_frequency DOUBLE"


@pytest.mark.parametrize(("orders", "retention"), [((2, 3, 1, 0), 0.5), ((2, 2, 2, 2), 0.95), ((1, 1, 0, 0), 0.05)])
def test_lifetime_value(spark, orders, retention):
    rows = [(i, f"C{i}", n, 100.0, 2.0) for i, n in enumerate(orders)]
    found = lifetime_value(spark.createDataFrame(rows, VALUE)).collect()
    years = sum(retention ** y / 1.1 ** y for y in (1, 2, 3))
    assert all(row.predicted_clv == pytest.approx(100.0 * 2.0 * 0.3 * years) for row in found)


def test_dense_rank_with_ties(spark, many_runs):
    rows = [(1, "a", 2, 10.0, 1.0), (2, "b", 2, 30.0, 1.0), (3, "c", 2, 30.0, 1.0), (4, "d", 2, 20.0, 1.0)]
    ranked = by_key(lifetime_value_ranked(spark.createDataFrame(rows, VALUE)), "customer_id")
    assert [ranked[i].clv_rank for i in (1, 2, 3, 4)] == [3, 1, 1, 2]


def test_global_ranks_equal_window_ranks_over_many_runs(spark, many_runs):
    draw = random.Random(3)
    # a third of the rows share one value
    rows = [(i, 0.0 if i % 3 == 0 else float(draw.randint(1, 400))) for i in range(5000)]
    df = spark.createDataFrame(rows, "id BIGINT, v DOUBLE").repartition(7)
    assert sorted_runs(df, "v", "id").select("_run").distinct().count() > 2
    levels = {value: place for place, value in enumerate(sorted({v for _, v in rows}, reverse=True), start=1)}
    dense = global_dense_rank(df, "v", "id", "rank").collect()
    assert len(dense) == 5000 and all(row.rank == levels[row.v] for row in dense)
    numbered = global_row_number(df, ["v", "id"], "n").collect()
    assert sorted((row.n, row.v, row.id) for row in numbered) == [
        (place, v, i) for place, (v, i) in enumerate(sorted((v, i) for i, v in rows), start=1)]


def test_rows_at_ranks_with_weights(spark, many_runs):
    df = spark.createDataFrame([(0, float(v), v) for v in range(1, 60)] + [(1, 5.0, 3)], "g INT, v DOUBLE, w INT")
    wide = sorted(v for v in range(1, 60) for _ in range(v))
    picked = rows_at_ranks(df, "g", ["v"], lambda n: [0, n // 3, n - 1], weight="w")
    assert picked[0].size == len(wide) and picked[1].size == 3
    assert {rank: row["v"] for rank, row in picked[0].rows.items()} == {
        rank: float(wide[rank]) for rank in (0, len(wide) // 3, len(wide) - 1)}
    assert {row["v"] for row in picked[1].rows.values()} == {5.0}


def test_unknown_values_have_no_rank_and_a_shared_value_spans_runs(spark, many_runs):
    rows = [(i, None if i < 50 else 1.0 if i < 700 else 2.0) for i in range(1000)]
    df = spark.createDataFrame(rows, "id BIGINT, v DOUBLE").repartition(4)
    found = {(row.v, row.rank) for row in global_dense_rank(df, "v", "id", "rank").collect()}
    assert found == {(None, None), (1.0, 2), (2.0, 1)}


def test_risk_band_edges(spark):
    probabilities = [0.35, 0.350001, 0.3501, 0.65, 0.6500001, 0.6501]
    df = spark.createDataFrame([(i, "n", p) for i, p in enumerate(probabilities)],
                               "customer_id BIGINT, name STRING, churn_probability DOUBLE")
    found = [row.risk_level for row in with_risk_level(df).orderBy("customer_id").collect()]
    assert found == ["Low", "Low", "Medium", "Medium", "Medium", "High"]


def test_both_churn_formulas(spark):
    columns = ("customer_id BIGINT, name STRING, recency_days INT, support_tickets BIGINT, "
               "campaign_response_rate DOUBLE, order_count BIGINT")
    df = spark.createDataFrame([(1, "a", 73, 3, 1.0, 24), (2, "b", 9999, 5, 0.0, 0)], columns)
    service = by_key(churn_scores(df), "customer_id")
    assert service[1].churn_probability == pytest.approx(0.15 + 0.2 * 0.65 + 0.1 - 0.15)
    assert service[2].churn_probability == pytest.approx(0.9) and service[2].risk_level == "High"
    behavioral = by_key(churn_scores(df, "behavioral"), "customer_id")
    assert behavioral[1].churn_probability == pytest.approx(0.08 + 0.2 * 0.78 - 0.16, abs=1e-4)
    assert behavioral[2].churn_probability == pytest.approx(0.86)


def test_health_bounds(spark):
    df = spark.createDataFrame([(0, 1.0, 5.0), (9999, 0.0, 0.0), (9999, 1.0, None)],
                               "recency_days INT, campaign_response_rate DOUBLE, avg_satisfaction DOUBLE")
    assert [row[0] for row in df.select(health()).collect()] == [100.0, 40.0, 60.0]


def actions_input(spark):
    columns = ("customer_id BIGINT, name STRING, recency_days INT, total_revenue DOUBLE, segment STRING, "
               "order_count BIGINT, product_diversity BIGINT, campaign_response_rate DOUBLE, predicted_clv DOUBLE")
    return spark.createDataFrame([
        (1, "late", 91, 5.0, "Platinum", 3, 1, 0.9, 10.0),
        (2, "vip", 90, 5.0, "Platinum", 3, 1, 0.9, 20.0),
        (3, "narrow", 5, 5.0, "Gold", 2, 1, 0.9, 30.0),
        (4, "keen", 5, 5.0, "Gold", 1, 1, 0.5, 40.0),
        (5, "quiet", 5, 5.0, "Gold", 1, 3, 0.4, 50.0),
        (6, "never", 9999, 0.0, "At-Risk", 0, 0, 0.0, 0.0),
        (7, "late too", 100, 5.0, "Silver", 1, 1, 0.0, 99.0),
        (8, "wide", 5, 5.0, "Gold", 4, 3, 0.0, 1.0),
    ], columns)


def test_first_rule_wins_and_queue_order(spark):
    queue = action_queue(next_best_actions(actions_input(spark))).collect()
    assert [(row.customer_id, row.priority) for row in queue] == [
        (7, "High"), (1, "High"), (3, "Medium"), (2, "Medium"), (4, "Low")]
    assert queue[1].reason == "No purchase for 91 days"
    wide = next_best_actions(actions_input(spark), narrow_range=3, campaigns=False).collect()
    assert {row.customer_id for row in wide} == {1, 2, 3, 7, 8}
    only = action_queue(next_best_actions(actions_input(spark)), ["Low"]).collect()
    assert [row.customer_id for row in only] == [4]


def test_action_summary(spark):
    row = rollups.action_summary(next_best_actions(actions_input(spark))).first()
    assert (row.actions, row.high_priority, row.value_represented, row.action_types) == (5, 2, 199.0, 4)
