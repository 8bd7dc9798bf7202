"""RFM scores and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.functions.numbers import band
from patronage.operators.ranking import rows_at_ranks

# Right-closed score bands.
SEGMENT_BANDS = [(4, "At-Risk"), (7, "Silver"), (9, "Gold"), (12, "Platinum")]
MEASURES = ["recency_days", "order_count", "total_revenue"]
PARTS = 4


def rfm_segments(master: DataFrame) -> DataFrame:
    """Quartile scores of recency, frequency and revenue among buyers, their sum and its segment.

    A buyer's quartile follows from the position among all buyers by value and
    then customer id. Only the three rows at the quartile seams of each measure
    are looked up; every customer is then compared with those, without a join.
    Fewer than four buyers all score 1, as do customers who never bought.
    """
    active = F.col("order_count") > 0
    seams = quartile_seams(master.filter(active))

    def quartile(measure: str) -> Column:
        place = F.lit(1)
        for value, tie in seams[measure]:
            beyond = (F.col(measure).cast("double") > F.lit(value)) | (
                (F.col(measure).cast("double") == F.lit(value)) & (F.col("customer_id") > F.lit(tie)))
            place = place + F.when(beyond, 1).otherwise(0)
        return place

    def score(measure: str, newest_first: bool) -> Column:
        if not seams[measure]:
            return F.lit(1)
        place = F.lit(PARTS + 1) - quartile(measure) if newest_first else quartile(measure)
        return F.when(active, place).otherwise(1)

    scored = master.withColumns({
        "r_score": score("recency_days", True).cast("int"),
        "f_score": score("order_count", False).cast("int"),
        "m_score": score("total_revenue", False).cast("int"),
    }).withColumn("rfm_score", F.col("r_score") + F.col("f_score") + F.col("m_score"))
    segment = F.when(F.col("order_count") == 0, "At-Risk").otherwise(band(F.col("rfm_score"), SEGMENT_BANDS))
    return scored.withColumn("segment", segment)


def quartile_seams(buyers: DataFrame) -> dict[str, list[tuple[float, int]]]:
    """Last (value, customer id) of the first three quarters of each measure; empty below four buyers.

    Position p of n (from 0) falls into quarter max(1, ceil(4 p / (n - 1))).
    """
    long = buyers.select(
        "customer_id",
        F.posexplode(F.array(*[F.col(measure).cast("double") for measure in MEASURES])).alias("measure", "value"),
    )

    def seam_ranks(n: int) -> list[int]:
        return [part * (n - 1) // PARTS for part in range(1, PARTS)] if n >= PARTS else []

    picked = rows_at_ranks(long, "measure", ["value", "customer_id"], seam_ranks)
    return {
        measure: [(row["value"], row["customer_id"]) for _, row in sorted(picked[number].rows.items())]
        if number in picked else []
        for number, measure in enumerate(MEASURES)
    }
