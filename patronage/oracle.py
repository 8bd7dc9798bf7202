"""The same answers in DuckDB SQL, for comparison.

Written for one process: global windows and whole-table sorts where the Spark side
works on ranges and partial sums.
"""

from __future__ import annotations

from patronage.functions.text import CATEGORY_KEYWORDS
from patronage.plans.churn_models import CATEGORICAL, NUMERIC, TRAIN_SHARE
from patronage.plans.churn_models import SEED as MODEL_SEED
from patronage.plans.mart import DATA_DICTIONARY


def rounded(expression: str, digits: int) -> str:
    return f"CAST(round(CAST({expression} AS DECIMAL(38,8)), {digits}) AS DOUBLE)"


def title(expression: str) -> str:
    runs = rf"regexp_extract_all({expression}, '(\p{{L}}+|[^\p{{L}}]+)')"
    return f"array_to_string(list_transform({runs}, lambda r: upper(r[1]) || lower(r[2:])), '')"


def month_label(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m')"


def month(expression: str) -> str:
    return f"CAST(date_trunc('month', {expression}) AS DATE)"


MONEY = "DECIMAL(18,6)"

PARTS = {
    "customers": ([], """
        SELECT c_custkey AS customer_id, c_name AS name,
               CASE WHEN c_custkey % 17 <> 0 THEN CAST(18 + c_custkey % 60 AS INTEGER) END AS age,
               CASE WHEN c_custkey % 10 = 9 THEN NULL WHEN c_custkey % 3 = 0 THEN 'Female'
                    WHEN c_custkey % 3 = 1 THEN 'Male' ELSE 'Non-binary' END AS gender,
               CAST(NULL AS VARCHAR) AS city, n_name AS state,
               coalesce(CAST(first_order AS DATE), DATE '1995-01-01') AS signup_date,
               CAST(NULL AS VARCHAR) AS email, TRUE AS is_active,
               CAST(coalesce(CAST(first_order AS DATE), DATE '1995-01-01') AS TIMESTAMP) AS created_at
        FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
        LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_order FROM orders GROUP BY o_custkey) f
               ON f.o_custkey = c_custkey"""),
    "products": ([], f"""
        SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category, p_retailprice AS unit_price,
               CAST(round(CAST(p_retailprice AS {MONEY}) * CAST(0.65 AS DECIMAL(3,2)), 2) AS DOUBLE) AS unit_cost
        FROM part"""),
    "transactions": ([], f"""
        SELECT l_orderkey * 10 + l_linenumber AS transaction_id, o_custkey AS customer_id,
               l_partkey AS product_id, CAST(l_quantity AS INTEGER) AS quantity,
               CAST(l_extendedprice AS {MONEY}) AS order_amount,
               CAST(round(CAST(l_extendedprice AS {MONEY}) * CAST(0.65 AS DECIMAL(3,2)), 2) AS {MONEY})
                   AS cost_amount,
               CAST(round(CAST(l_extendedprice AS {MONEY}) * CAST(l_discount AS DECIMAL(4,2)), 2) AS {MONEY})
                   AS discount_amount,
               o_orderdate AS order_date, o_orderpriority AS channel,
               CASE WHEN l_returnflag = 'R' THEN 'cancelled' ELSE 'completed' END AS status
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""),
    "marketing": ([], """
        SELECT event_id AS campaign_id, user_id AS customer_id, event_type = 'purchase' AS campaign_response,
               event_type AS channel, value AS campaign_cost, ts AS touched_at
        FROM events WHERE event_type IN ('click', 'view', 'purchase')"""),
    "support": ([], """
        SELECT event_id AS ticket_id, user_id AS customer_id, value AS resolution_time, 'closed' AS ticket_status,
               1 + 4 * CAST(json_extract_string(props, '$.k') AS DOUBLE) / 99 AS satisfaction_score, ts AS opened_at
        FROM events WHERE event_type = 'error'"""),
    "sales": (["transactions"], """
        SELECT customer_id, sum(order_amount) AS revenue, sum(order_amount - cost_amount - discount_amount) AS profit,
               count(DISTINCT transaction_id) AS order_count, count(order_amount) AS priced,
               max(order_date) AS last_purchase_date, min(order_date) AS first_purchase_date,
               count(DISTINCT product_id) AS product_diversity
        FROM transactions WHERE lower(status) = 'completed' GROUP BY customer_id"""),
    "touches": (["marketing"], f"""
        SELECT customer_id, count(campaign_id) AS campaigns_received,
               count(*) FILTER (campaign_response) AS campaign_responses,
               CAST(sum(CAST(campaign_cost AS {MONEY})) AS DOUBLE) AS marketing_cost,
               CAST(count(*) FILTER (campaign_response) AS DOUBLE) / count(campaign_id) AS campaign_response_rate
        FROM marketing GROUP BY customer_id"""),
    "tickets": (["support"], """
        SELECT customer_id, count(ticket_id) AS support_tickets,
               CAST(sum(CAST(resolution_time AS DECIMAL(28,10))) AS DOUBLE) / count(resolution_time)
                   AS avg_resolution_hours,
               CAST(sum(CAST(satisfaction_score AS DECIMAL(28,10))) AS DOUBLE) / count(satisfaction_score)
                   AS avg_satisfaction
        FROM support GROUP BY customer_id"""),
    "moment": (["transactions"], "SELECT max(order_date) + INTERVAL 1 DAY AS as_of FROM transactions"),
    "joined": (["customers", "sales", "touches", "tickets", "moment"], """
        SELECT c.*, coalesce(CAST(s.revenue AS DOUBLE), 0) AS total_revenue,
               coalesce(CAST(s.profit AS DOUBLE), 0) AS total_profit,
               coalesce(s.order_count, 0) AS order_count,
               coalesce(CAST(s.revenue AS DOUBLE) / s.priced, 0) AS average_order_value,
               s.last_purchase_date, s.first_purchase_date, coalesce(s.product_diversity, 0) AS product_diversity,
               CAST(CASE WHEN s.last_purchase_date IS NULL THEN 9999
                    ELSE greatest(date_sub('day', s.last_purchase_date, as_of), 0) END AS INTEGER) AS recency_days,
               coalesce(t.campaigns_received, 0) AS campaigns_received,
               coalesce(t.campaign_responses, 0) AS campaign_responses,
               coalesce(t.marketing_cost, 0) AS marketing_cost,
               coalesce(t.campaign_response_rate, 0) AS campaign_response_rate,
               coalesce(k.support_tickets, 0) AS support_tickets,
               coalesce(k.avg_resolution_hours, 0) AS avg_resolution_hours,
               coalesce(k.avg_satisfaction, 0) AS avg_satisfaction,
               CAST(greatest(date_sub('day', CAST(c.signup_date AS TIMESTAMP), as_of), 1) AS INTEGER) AS tenure_days
        FROM customers c LEFT JOIN sales s USING (customer_id) LEFT JOIN touches t USING (customer_id)
        LEFT JOIN tickets k USING (customer_id) CROSS JOIN moment"""),
    "master": (["joined"], """
        SELECT *, order_count / greatest(tenure_days / CAST(365.25 AS DOUBLE), CAST(1 AS DOUBLE))
                  AS purchase_frequency
        FROM joined"""),
    "places": (["master"], """
        SELECT customer_id, count(*) OVER () AS n,
               row_number() OVER (ORDER BY recency_days, customer_id) AS r,
               row_number() OVER (ORDER BY order_count, customer_id) AS f,
               row_number() OVER (ORDER BY total_revenue, customer_id) AS m
        FROM master WHERE order_count > 0"""),
    "quarters": (["places"], """
        SELECT customer_id,
               CASE WHEN n < 4 THEN 1 ELSE 5 - greatest(1, (4 * (r - 1) + n - 2) // (n - 1)) END AS r,
               CASE WHEN n < 4 THEN 1 ELSE greatest(1, (4 * (f - 1) + n - 2) // (n - 1)) END AS f,
               CASE WHEN n < 4 THEN 1 ELSE greatest(1, (4 * (m - 1) + n - 2) // (n - 1)) END AS m
        FROM places"""),
    "scored": (["master", "quarters"], """
        SELECT master.*, CAST(coalesce(r, 1) AS INTEGER) AS r_score, CAST(coalesce(f, 1) AS INTEGER) AS f_score,
               CAST(coalesce(m, 1) AS INTEGER) AS m_score,
               CAST(coalesce(r + f + m, 3) AS INTEGER) AS rfm_score
        FROM master LEFT JOIN quarters USING (customer_id)"""),
    "segmented": (["scored"], """
        SELECT *, CASE WHEN order_count = 0 OR rfm_score <= 4 THEN 'At-Risk' WHEN rfm_score <= 7 THEN 'Silver'
                       WHEN rfm_score <= 9 THEN 'Gold' ELSE 'Platinum' END AS segment
        FROM scored"""),
    "yearly": (["master"], """
        SELECT least(greatest(CAST(count(*) FILTER (order_count > 1) AS DOUBLE) / count(*), CAST(0.05 AS DOUBLE)),
                     CAST(0.95 AS DOUBLE)) / CAST(1.1 AS DOUBLE) AS y FROM master"""),
    "valued": (["segmented", "yearly"], """
        SELECT segmented.*, greatest(average_order_value * purchase_frequency * CAST(0.3 AS DOUBLE)
                                     * (y + y * y + y * y * y), CAST(0 AS DOUBLE)) AS predicted_clv
        FROM segmented CROSS JOIN yearly"""),
    "ranked": (["valued"], """
        SELECT *, CAST(dense_rank() OVER (ORDER BY predicted_clv DESC) AS INTEGER) AS clv_rank FROM valued"""),
    "months": (["transactions"], f"""
        SELECT {month('order_date')} AS month, sum(order_amount) AS revenue
        FROM transactions WHERE status = 'completed' GROUP BY 1"""),
    "calendar": (["months"], """
        SELECT CAST(unnest(generate_series(CAST(min(month) AS TIMESTAMP), CAST(max(month) AS TIMESTAMP),
                                           INTERVAL 1 MONTH)) AS DATE) AS month FROM months"""),
    "monthly": (["months", "calendar"], """
        SELECT month, coalesce(revenue, 0) AS revenue FROM calendar LEFT JOIN months USING (month)"""),
    "growth": (["monthly"], """
        SELECT coalesce((CAST(revenue AS DOUBLE) - before) / nullif(before, 0) * 100, 0) AS growth_pct
        FROM (SELECT month, revenue, CAST(lag(revenue) OVER (ORDER BY month) AS DOUBLE) AS before FROM monthly)
        ORDER BY month DESC LIMIT 1"""),
    "markets": (["master"], f"""
        SELECT state, count(customer_id) AS customers, {rounded("sum(CAST(total_revenue AS DECIMAL(28,4)))", 2)} AS revenue
        FROM master WHERE state IS NOT NULL GROUP BY state"""),
    "categories": (["transactions", "products"], f"""
        SELECT category, {rounded("sum(order_amount)", 2)} AS order_amount
        FROM transactions LEFT JOIN products USING (product_id)
        WHERE status = 'completed' AND category IS NOT NULL GROUP BY category"""),
    "service": (["master"], f"""
        SELECT customer_id, name, {rounded('''least(greatest(CAST(0.15 AS DOUBLE)
                + least(greatest(recency_days / CAST(365 AS DOUBLE), CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE))
                  * CAST(0.65 AS DOUBLE)
                + CASE WHEN support_tickets > 2 THEN CAST(0.1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
                - campaign_response_rate * CAST(0.15 AS DOUBLE), CAST(0.01 AS DOUBLE)), CAST(0.99 AS DOUBLE))''', 4)}
               AS churn_probability FROM master"""),
    "behavioral": (["master"], f"""
        SELECT customer_id, name, {rounded('''least(greatest(CAST(0.08 AS DOUBLE)
                + least(greatest(recency_days, 0), 365) / CAST(365 AS DOUBLE) * CAST(0.78 AS DOUBLE)
                - ln(1 + CAST(order_count AS DOUBLE)) / ln(CAST(25 AS DOUBLE)) * CAST(0.16 AS DOUBLE),
                CAST(0.01 AS DOUBLE)), CAST(0.99 AS DOUBLE))''', 4)} AS churn_probability FROM master"""),
    "risk": (["service"], """
        SELECT *, CASE WHEN churn_probability <= 0.35 THEN 'Low' WHEN churn_probability <= 0.65 THEN 'Medium'
                       ELSE 'High' END AS risk_level FROM service"""),
    "ruled": (["valued"], f"""
        SELECT customer_id, name AS customer_name,
               CASE WHEN recency_days > 90 AND total_revenue > 0 THEN 1 WHEN segment = 'Platinum' THEN 2
                    WHEN order_count >= 2 AND product_diversity <= 1 THEN 3
                    WHEN campaign_response_rate >= 0.5 THEN 4 END AS rule,
               CASE WHEN recency_days > 90 AND total_revenue > 0 THEN 1 WHEN segment = 'Platinum' THEN 2
                    WHEN order_count >= 2 AND product_diversity <= 3 THEN 3 END AS wide_rule,
               recency_days, {rounded("predicted_clv", 2)} AS expected_value
        FROM valued"""),
    "health": (["master"], """
        SELECT *, least(greatest(CAST(100 AS DOUBLE)
                - least(greatest(recency_days, 0), 365) / CAST(365 AS DOUBLE) * 60
                + campaign_response_rate * 20 + avg_satisfaction / 5 * 20, CAST(0 AS DOUBLE)), CAST(100 AS DOUBLE)) AS health
        FROM master"""),
    "retail": ([], f"""
        SELECT CASE WHEN l_returnflag = 'R' THEN 'C' ELSE '' END || l_orderkey AS invoice,
               'P' || lpad(CAST(l_partkey AS VARCHAR), 6, '0') AS stock_code, {title("trim(p_name)")} AS description,
               CAST(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS DOUBLE) AS quantity,
               o_orderdate AS invoice_date,
               CAST(round(CAST(l_extendedprice / l_quantity AS DECIMAL(18,8)), 2) AS DOUBLE) AS unit_price,
               o_custkey AS customer_id, n_name AS country, l_returnflag = 'R' AS is_cancelled
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN part ON p_partkey = l_partkey
        LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey"""),
    "latest": (["retail"], """
        SELECT * FROM (
            SELECT *, row_number() OVER (PARTITION BY stock_code
                ORDER BY invoice_date DESC, invoice DESC, unit_price DESC, description DESC) AS back
            FROM retail WHERE stock_code IS NOT NULL AND description IS NOT NULL AND unit_price > 0)
        WHERE back = 1"""),
    "retail_products": (["latest"], f"""
        SELECT stock_code, row_number() OVER (ORDER BY stock_code) AS product_id, description AS product_name,
               {{category}} AS category, unit_price,
               CAST(round(CAST(unit_price AS {MONEY}) * CAST(0.65 AS DECIMAL(3,2)), 2) AS DOUBLE) AS unit_cost
        FROM latest"""),
    "purchases": (["retail", "retail_products"], f"""
        SELECT retail.*, product_id, CAST(abs(quantity) AS INTEGER) AS units,
               CAST(round(CAST(abs(quantity) AS INTEGER) * CAST(retail.unit_price AS {MONEY}), 2) AS {MONEY}) AS order_amount
        FROM retail JOIN retail_products USING (stock_code)
        WHERE customer_id IS NOT NULL AND invoice_date IS NOT NULL AND quantity <> 0 AND retail.unit_price > 0"""),
    "retail_months": (["purchases"], f"""
        SELECT {month('invoice_date')} AS month, sum(order_amount) AS revenue, count(DISTINCT invoice) AS orders,
               sum(units) AS units FROM purchases WHERE NOT is_cancelled GROUP BY 1"""),
    "retail_monthly": (["retail_months"], """
        SELECT c.month AS invoice_date, coalesce(CAST(revenue AS DOUBLE), 0) AS revenue, coalesce(orders, 0) AS orders,
               CAST(coalesce(units, 0) AS BIGINT) AS units
        FROM (SELECT CAST(unnest(generate_series(CAST(min(month) AS TIMESTAMP), CAST(max(month) AS TIMESTAMP),
                                                 INTERVAL 1 MONTH)) AS DATE) AS month FROM retail_months) c
        LEFT JOIN retail_months USING (month)"""),
    "retail_countries": (["retail"], """
        SELECT customer_id, country, n, first, row_number() OVER (PARTITION BY customer_id
               ORDER BY country IS NULL, n DESC, country) AS place
        FROM (SELECT customer_id, country, count(*) AS n, min(invoice_date) AS first FROM retail GROUP BY ALL)"""),
    "records": ([], f"""
        SELECT * FROM (
            SELECT c_custkey AS customer_id, {title('''trim('  o''brien ' || lower(c_name) || ' x2y ')''')} AS name,
                   10 + (o_orderkey + c_custkey) % 110 AS age,
                   CASE o_orderkey % 5 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' WHEN 2 THEN 'Female'
                        WHEN 3 THEN 'Non-Binary' END AS gender,
                   {title('lower(n_name)')} AS state, CAST(o_orderdate AS DATE) AS signup_date,
                   o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') AS is_active,
                   row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey DESC) AS back
            FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)
        WHERE back = 1"""),
    "cleaned": (["records"], """
        SELECT customer_id, name, CAST(round_even(CAST(coalesce(
                   CASE WHEN age BETWEEN 16 AND 110 THEN age END,
                   (SELECT quantile_cont(age, 0.5) FROM records WHERE age BETWEEN 16 AND 110)) AS DOUBLE), 0)
                   AS INTEGER) AS age, gender, state, signup_date, is_active
        FROM records"""),
    "touched": ([], f"""
        SELECT event_id AS campaign_id, CASE WHEN event_type <> 'view' THEN user_id END AS customer_id,
               CASE WHEN event_type <> 'error' THEN ts END AS touched_at,
               CASE WHEN event_type <> 'error' THEN CAST(CAST(value AS {MONEY}) AS DOUBLE) END AS campaign_cost
        FROM events"""),
    "state_months": (["transactions", "customers"], f"""
        SELECT s.series, {month('order_date')} AS month, sum(order_amount) AS revenue
        FROM transactions LEFT JOIN customers USING (customer_id),
             (SELECT 0 AS pick UNION ALL SELECT 1) p,
             LATERAL (SELECT CASE WHEN pick = 0 THEN 'total' ELSE state END AS series) s
        WHERE status = 'completed' AND s.series IS NOT NULL GROUP BY 1, 2"""),
    "series": (["state_months"], """
        SELECT c.series, c.month, coalesce(CAST(revenue AS DOUBLE), 0) AS revenue
        FROM (SELECT series, CAST(unnest(generate_series(CAST(min(month) AS TIMESTAMP), CAST(max(month) AS TIMESTAMP),
                     INTERVAL 1 MONTH)) AS DATE) AS month FROM state_months GROUP BY series) c
        LEFT JOIN state_months USING (series, month)"""),
    "lagged": (["series"], """
        SELECT series, month, revenue AS target, lag(revenue, 1) OVER w AS lag_1, lag(revenue, 2) OVER w AS lag_2,
               lag(revenue, 3) OVER w AS lag_3, lag(revenue, 6) OVER w AS lag_6,
               CASE WHEN count(*) OVER v = 3
                    THEN CAST(sum(CAST(revenue AS DECIMAL(28,4))) OVER v AS DOUBLE) / 3 END AS rolling_3,
               CAST(month(month) AS DOUBLE) AS month_number
        FROM series
        WINDOW w AS (PARTITION BY series ORDER BY month),
               v AS (PARTITION BY series ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"""),
    "complete": (["lagged"], "SELECT * FROM lagged WHERE lag_6 IS NOT NULL AND rolling_3 IS NOT NULL"),
    "averages": (["series"], """
        SELECT series, max(month) AS last, CAST(sum(CAST(revenue AS DECIMAL(28,4))) AS DOUBLE) / count(*) AS value
        FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY month DESC) AS back FROM series)
        WHERE back <= 3 GROUP BY series"""),
}


def category_of(expression: str) -> str:
    cases = " ".join(
        "WHEN " + " OR ".join(f"contains({expression}, '{word}')" for word in words) + f" THEN '{category}'"
        for category, words in CATEGORY_KEYWORDS.items())
    return f"CASE {cases} ELSE 'Other' END"


PARTS["retail_products"] = (PARTS["retail_products"][0],
                            PARTS["retail_products"][1].replace("{category}", category_of("upper(description)")))


def sql(select: str, *parts: str) -> str:
    """``select`` behind the common table expressions it needs."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in PARTS[name][0]:
            add(needed)
        if name not in order:
            order.append(name)

    for part in parts:
        add(part)
    if not order:
        return select
    return "WITH " + ",\n".join(f"{name} AS ({PARTS[name][1]})" for name in order) + "\n" + select


MASTER = """customer_id, name, age, gender, city, state, signup_date, email, is_active, created_at, total_revenue,
    total_profit, order_count, average_order_value, last_purchase_date, first_purchase_date, product_diversity,
    recency_days, campaigns_received, campaign_responses, marketing_cost, campaign_response_rate, support_tickets,
    avg_resolution_hours, avg_satisfaction, tenure_days, purchase_frequency"""
ACTIONS = {1: ("Retention outreach", None, "High"),
           2: ("VIP loyalty offer", "High RFM value and engagement", "Medium"),
           3: ("Cross-sell adjacent category", "Repeat buyer with narrow category mix", "Medium"),
           4: ("Target next campaign", "Historically responsive to marketing", "Low")}


def actions(rule: str) -> str:
    def case(place: int) -> str:
        whens = []
        for number, texts in ACTIONS.items():
            text = texts[place]
            value = f"'{text}'" if text else "'No purchase for ' || recency_days || ' days'"
            whens.append(f"WHEN {number} THEN {value}")
        return f"CASE {rule} {' '.join(whens)} END"

    return (f"SELECT customer_id, customer_name, {case(0)} AS action, {case(1)} AS reason, {case(2)} AS priority, "
            f"expected_value FROM ruled WHERE {rule} IS NOT NULL")


QUEUE = """ORDER BY CASE priority WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END, expected_value DESC,
    customer_id"""
CUSTOMER_TYPES = {"customer_id": "bigint", "name": "string", "age": "int", "gender": "string", "city": "string",
                  "state": "string", "signup_date": "date", "email": "string", "is_active": "boolean",
                  "created_at": "timestamp_ntz"}
TRANSACTION_TYPES = {"transaction_id": "bigint", "customer_id": "bigint", "product_id": "bigint", "quantity": "int",
                     "order_amount": "decimal(18,6)", "cost_amount": "decimal(18,6)",
                     "discount_amount": "decimal(18,6)", "order_date": "timestamp_ntz", "channel": "string",
                     "status": "string"}


def profile(table: str, types: dict[str, str]) -> str:
    def line(name: str, kind: str) -> str:
        if kind in ("bigint", "int") or kind.startswith("decimal"):
            value = f"CAST({name} AS DOUBLE)"
            stats = [f"count({name})", f"CAST(sum(CAST({name} AS DECIMAL(38,8))) AS DOUBLE) / count({name})",
                     f"stddev_samp({value})", f"min({value})",
                     *[f"quantile_cont({value}, {part})" for part in (0.25, 0.5, 0.75)], f"max({value})"]
            stats = [rounded(stat, 2) for stat in stats]
        else:
            stats = ["CAST(NULL AS DOUBLE)"] * 8
        names = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]
        shown = ", ".join(f'{stat} AS "{metric}"' for stat, metric in zip(stats, names, strict=True))
        return (f"SELECT count(*) AS row_count, {len(types)} AS column_count, "
                f"count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {table})) AS duplicate_rows, "
                f"'{name}' AS column_name, '{kind}' AS data_type, count(*) - count({name}) AS missing, {shown} "
                f"FROM {table}")

    return sql("\nUNION ALL ".join(line(name, kind) for name, kind in types.items()), table)


def audit() -> str:
    rules = [(table, f"{name} not null", f"{name} IS NULL") for table, names in {
        "customers": ["customer_id", "name", "signup_date", "is_active", "created_at"],
        "products": ["product_id", "product_name", "category", "unit_price", "unit_cost"],
        "transactions": ["transaction_id", "customer_id", "quantity", "order_amount", "cost_amount",
                         "discount_amount", "order_date", "status"],
        "marketing": ["campaign_id", "customer_id", "campaign_response", "campaign_cost", "touched_at"],
        "support": ["ticket_id", "customer_id", "ticket_status", "opened_at"],
    }.items() for name in names]
    rules += [("customers", "age between 16 and 110", "age NOT BETWEEN 16 AND 110"),
              ("products", "unit_price >= 0", "unit_price < 0"), ("products", "unit_cost >= 0", "unit_cost < 0"),
              ("transactions", "quantity > 0", "quantity <= 0"),
              ("transactions", "order_amount >= 0", "order_amount < 0")]
    lines = [f"SELECT '{table}' AS table_name, '{rule}' AS rule, count(*) FILTER ({broken}) AS violations FROM {table}"
             for table, rule, broken in rules]
    lines += [f"SELECT '{table}', '{key} unique', count({key}) - count(DISTINCT {key}) FROM {table}"
              for table, key in [("customers", "customer_id"), ("customers", "email"), ("products", "product_id"),
                                 ("transactions", "transaction_id"), ("marketing", "campaign_id"),
                                 ("support", "ticket_id")]]
    lines += [f"SELECT '{table}', '{key} references', count(*) FROM {table} t "
              f"WHERE t.{key} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{key} = t.{key})"
              for table, key, parent in [("transactions", "customer_id", "customers"),
                                         ("transactions", "product_id", "products"),
                                         ("marketing", "customer_id", "customers"),
                                         ("support", "customer_id", "customers")]]
    return sql("\nUNION ALL ".join(lines), "customers", "products", "transactions", "marketing", "support")


def counts(metrics: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS metric, CAST({value} AS BIGINT) AS value FROM {source}"
                              for name, value in metrics.items())


TOTAL_REVENUE = rounded("sum(CAST(total_revenue AS DECIMAL(28,4)))", 2)
TOTAL_PROFIT = rounded("sum(CAST(total_profit AS DECIMAL(28,4)))", 2)


def exact_mean(expression: str) -> str:
    return f"CAST(sum(CAST({expression} AS DECIMAL(38,8))) AS DOUBLE) / count({expression})"


TOP_SEGMENT = "SELECT segment FROM segmented GROUP BY segment ORDER BY count(*) DESC, segment LIMIT 1"

ORACLE = {
    "customer_master_full": sql(f"SELECT {MASTER} FROM master", "master"),
    "master_view": sql("""
        SELECT customer_id, name, age, gender, city, state, signup_date, order_count, total_revenue, total_profit,
               average_order_value, last_purchase_date, product_diversity, campaigns_received,
               campaign_response_rate, support_tickets AS support_ticket_count, avg_resolution_hours
        FROM master""", "master"),
    "customer_profile_row": sql(f"SELECT {MASTER} FROM master WHERE customer_id = 1", "master"),
    "customer_documents": sql("""
        SELECT CAST(json_object('customer_id', customer_id, 'name', name, 'state', state, 'city', city,
               'signup_date', strftime(signup_date, '%Y-%m-%dT%H:%M:%S'), 'order_count', order_count,
               'last_purchase_date', strftime(last_purchase_date, '%Y-%m-%dT%H:%M:%S')) AS VARCHAR) AS document
        FROM master""", "master"),
    "rfm_scores": sql("""
        SELECT customer_id, recency_days, order_count, total_revenue, name, r_score, f_score, m_score, rfm_score,
               segment FROM segmented""", "segmented"),
    "segment_rollup": sql(f"""
        SELECT segment, count(customer_id) AS customers, {TOTAL_REVENUE} AS revenue
        FROM segmented GROUP BY segment""", "segmented"),
    "segment_counts": sql("SELECT segment, count(*) AS customers FROM segmented GROUP BY segment", "segmented"),
    "segment_score_distribution": sql(
        "SELECT segment, rfm_score, count(*) AS customers FROM segmented GROUP BY ALL", "segmented"),
    "segment_listing": sql(
        "SELECT customer_id, name, rfm_score, segment FROM segmented ORDER BY rfm_score DESC, customer_id",
        "segmented"),
    "top_segment": sql(f"SELECT ({TOP_SEGMENT}) AS top_segment", "segmented"),
    "clv_ranked": sql("SELECT customer_id, name, predicted_clv, clv_rank FROM ranked", "ranked"),
    "top_clv": sql("""SELECT customer_id, name, predicted_clv, clv_rank FROM ranked
        ORDER BY clv_rank, customer_id LIMIT 100""", "ranked"),
    "clv_leaders": sql("""SELECT * FROM (SELECT customer_id, name, predicted_clv, clv_rank FROM ranked
        ORDER BY clv_rank, customer_id LIMIT 30) ORDER BY predicted_clv, customer_id""", "ranked"),
    "clv_summary": sql(f"""
        SELECT count(*) AS customers_ranked, {rounded("max(predicted_clv)", 2)} AS top_clv,
               {rounded("median(predicted_clv)", 2)} AS median_clv
        FROM ranked""", "ranked"),
    "top_customers": sql("""
        SELECT customer_id, name, state, total_revenue, order_count, recency_days, segment, predicted_clv
        FROM valued ORDER BY total_revenue DESC, customer_id LIMIT 100""", "valued"),
    "customer_health": sql(f"SELECT customer_id, {rounded('health', 4)} AS health_score FROM health", "health"),
    "executive_kpis": sql(f"""
        SELECT count(DISTINCT customer_id) AS customers,
               count(*) FILTER (recency_days <= 90) AS active_customers,
               {TOTAL_REVENUE} AS revenue, {TOTAL_PROFIT} AS profit,
               {rounded("CAST(count(*) FILTER (recency_days > 90) AS DOUBLE) / count(*) * 100", 2)} AS churn_rate,
               {rounded("(1 - CAST(count(*) FILTER (recency_days > 90) AS DOUBLE) / count(*)) * 100", 2)}
                   AS retention_rate,
               {rounded(exact_mean("average_order_value"), 2)} AS average_order_value,
               {rounded(exact_mean("campaign_response_rate") + " * 100", 2)} AS campaign_conversion_rate,
               {rounded(exact_mean("health"), 2)} AS customer_health_score,
               {rounded("(SELECT growth_pct FROM growth)", 2)} AS revenue_growth_pct,
               ({TOP_SEGMENT}) AS top_segment,
               {rounded(f"{TOTAL_PROFIT} / {TOTAL_REVENUE} * 100", 2)} AS margin_pct
        FROM health""", "health", "segmented", "growth"),
    "bi_measures": sql(f"""
        SELECT {TOTAL_REVENUE} AS total_revenue, {TOTAL_PROFIT} AS total_profit,
               count(DISTINCT customer_id) AS customer_count,
               {rounded("CAST(sum(CAST(total_revenue AS DECIMAL(28,4))) AS DOUBLE) / sum(order_count)", 2)}
                   AS average_order_value,
               count(DISTINCT customer_id) FILTER (recency_days > 90) AS at_risk_customers,
               {rounded('''1 - CAST(count(DISTINCT customer_id) FILTER (recency_days > 90) AS DOUBLE)
                   / count(DISTINCT customer_id)''', 4)} AS retention_rate,
               {rounded("sum(CAST(predicted_clv AS DECIMAL(38,8)))", 2)} AS predicted_clv
        FROM valued""", "valued"),
    "dataset_header": sql("""
        SELECT 'Demo or uploaded data' AS source,
               count(*) AS transactions, (SELECT count(*) FROM products) AS products,
               (SELECT count(*) FROM customers) AS customers,
               strftime(min(order_date), '%Y-%m-%dT%H:%M:%S') AS date_start,
               strftime(max(order_date), '%Y-%m-%dT%H:%M:%S') AS date_end,
               (SELECT count(DISTINCT state) FROM customers) AS markets
        FROM transactions""", "transactions", "products", "customers"),
    "monthly_revenue": sql(
        f"SELECT {month_label('month')} AS month, {rounded('revenue', 2)} AS revenue FROM monthly", "monthly"),
    "monthly_revenue_all_statuses": sql(
        f"""SELECT {month_label('month')} AS month, {rounded('revenue', 2)} AS revenue FROM monthly""",
        "monthly").replace("WHERE status = 'completed' GROUP BY 1", "GROUP BY 1"),
    "monthly_growth": sql(f"SELECT {rounded('growth_pct', 2)} AS growth_pct FROM growth", "growth"),
    "category_revenue": sql(
        "SELECT category, order_amount FROM categories ORDER BY order_amount DESC, category", "categories"),
    "geography": sql("SELECT state, customers, revenue FROM markets", "markets"),
    "market_summary": sql("""
        SELECT count(*) AS markets, (SELECT state FROM markets ORDER BY revenue DESC, state LIMIT 1) AS leading_market,
               max(revenue) AS top_revenue FROM markets""", "markets"),
    "top_markets": sql("SELECT state, customers, revenue FROM markets ORDER BY revenue DESC, state LIMIT 20",
                       "markets"),
    "market_listing": sql("SELECT state, customers, revenue FROM markets ORDER BY revenue DESC, state", "markets"),
    "demographics": sql(f"""
        SELECT gender, count(customer_id) AS customers, {TOTAL_REVENUE} AS revenue FROM master GROUP BY gender""",
                        "master"),
    "age_bands": sql("""
        SELECT CASE WHEN age <= 24 THEN '18-24' WHEN age <= 34 THEN '25-34' WHEN age <= 44 THEN '35-44'
                    WHEN age <= 54 THEN '45-54' WHEN age <= 64 THEN '55-64' ELSE '65+' END AS age_band,
               count(*) AS customers
        FROM customers WHERE age > 0 AND age <= 120 GROUP BY 1""", "customers"),
    "cohorts": sql(f"""
        SELECT coalesce({month_label('signup_date')}, 'NaT') AS cohort, {month_label('order_date')} AS activity_month,
               count(DISTINCT customer_id) AS active_customers
        FROM transactions LEFT JOIN customers USING (customer_id) GROUP BY 1, 2""", "transactions", "customers"),
    "product_performance": sql(f"""
        SELECT category, product_name, {rounded("sum(order_amount)", 2)} AS revenue,
               CAST(sum(quantity) AS BIGINT) AS units, count(DISTINCT transaction_id) AS orders
        FROM transactions LEFT JOIN products USING (product_id)
        WHERE category IS NOT NULL AND product_name IS NOT NULL GROUP BY category, product_name""",
                               "transactions", "products"),
    "churn_service": sql("SELECT * FROM risk ORDER BY churn_probability DESC, customer_id", "risk"),
    "churn_behavioral": sql("""
        SELECT *, CASE WHEN churn_probability <= 0.35 THEN 'Low' WHEN churn_probability <= 0.65 THEN 'Medium'
                       ELSE 'High' END AS risk_level
        FROM behavioral ORDER BY churn_probability DESC, customer_id""", "behavioral"),
    "risk_summary": sql(f"""
        SELECT count(*) FILTER (risk_level = 'Low') AS low, count(*) FILTER (risk_level = 'Medium') AS medium,
               count(*) FILTER (risk_level = 'High') AS high,
               {rounded("CAST(count(*) FILTER (risk_level = 'High') AS DOUBLE) / count(*) * 100", 2)} AS high_pct,
               {rounded(exact_mean("churn_probability"), 4)} AS mean_probability, count(*) AS scored
        FROM risk""", "risk"),
    "risk_levels": sql("SELECT risk_level, count(*) AS customers FROM risk GROUP BY risk_level", "risk"),
    "churn_histogram": sql("""
        SELECT CAST(least(floor(CAST(25 AS DOUBLE) * churn_probability + 1), 25) AS INTEGER) AS bin,
               count(*) AS customers FROM risk GROUP BY 1""", "risk"),
    "next_best_action": sql(actions("rule"), "ruled"),
    "next_best_action_wide_range": sql(actions("wide_rule"), "ruled"),
    "action_queue_top100": sql(f"SELECT * FROM ({actions('rule')}) {QUEUE} LIMIT 100", "ruled"),
    "action_queue_by_priority": sql(
        f"SELECT * FROM ({actions('rule')}) WHERE priority IN ('Medium', 'Low') {QUEUE}", "ruled"),
    "action_summary": sql(f"""
        SELECT count(*) AS actions, count(*) FILTER (priority = 'High') AS high_priority,
               {rounded("coalesce(sum(CAST(expected_value AS DECIMAL(28,4))), 0)", 2)} AS value_represented,
               count(DISTINCT action) AS action_types FROM ({actions('rule')})""", "ruled"),
    "action_counts": sql(
        f"SELECT action, priority, count(*) AS customers FROM ({actions('rule')}) GROUP BY ALL", "ruled"),
    "clean_strict_customers": sql("SELECT * FROM cleaned", "cleaned"),
    "clean_strict_transactions": f"""
        SELECT transaction_id, customer_id, product_id, order_amount, discount_amount, order_date, status FROM (
            SELECT l_orderkey * 10 + l_linenumber AS transaction_id, o_custkey AS customer_id, l_partkey AS product_id,
                   CASE WHEN l_returnflag = 'R' THEN CAST(0 AS DOUBLE)
                        ELSE CAST(CAST(l_extendedprice AS {MONEY}) AS DOUBLE) END AS order_amount,
                   l_discount AS discount_amount, o_orderdate AS order_date,
                   CASE WHEN l_linestatus = 'O' THEN 'Pending' ELSE 'completed' END AS status,
                   row_number() OVER (PARTITION BY l_orderkey * 10 + l_linenumber
                       ORDER BY l_shipdate DESC, l_partkey DESC, l_extendedprice DESC, l_discount DESC,
                                l_returnflag DESC, l_linestatus DESC) AS back
            FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
        WHERE back = 1""",
    "clean_report_marketing": sql("SELECT * FROM touched", "touched"),
    "upload_preview": sql("SELECT * FROM touched ORDER BY campaign_id LIMIT 250", "touched"),
    "cleaning_counts": sql(counts({
        "rows_received": "count(*)", "duplicates_removed": "count(*) - count(DISTINCT campaign_id)", "columns": "4",
        "rows_standardized": "count(DISTINCT campaign_id)",
        "missing_values": "4 * count(*) - count(campaign_id) - count(customer_id) - count(touched_at) "
                          "- count(campaign_cost)",
        "invalid_campaign_id": "count(*) - count(campaign_id)",
        "invalid_customer_id": "count(*) - count(customer_id)",
        "invalid_touched_at": "count(*) - count(touched_at)"}, "touched").replace(
            "SELECT 'columns' AS metric, CAST(4 AS BIGINT) AS value FROM touched",
            "SELECT 'columns' AS metric, CAST(4 AS BIGINT) AS value"), "touched"),
    "profile_customers": profile("customers", CUSTOMER_TYPES),
    "profile_transactions": profile("transactions", TRANSACTION_TYPES),
    "constraints": audit(),
    "upsert_customers": sql("""
        SELECT coalesce(b.customer_id, c.customer_id) AS customer_id,
               CASE WHEN b.customer_id IS NOT NULL THEN b.name ELSE c.name END AS name,
               CASE WHEN b.customer_id IS NOT NULL THEN b.age ELSE c.age END AS age,
               CASE WHEN b.customer_id IS NOT NULL THEN b.gender ELSE c.gender END AS gender, c.city,
               CASE WHEN b.customer_id IS NOT NULL THEN b.state ELSE c.state END AS state,
               CASE WHEN b.customer_id IS NOT NULL THEN b.signup_date ELSE c.signup_date END AS signup_date, c.email,
               CASE WHEN b.customer_id IS NOT NULL THEN b.is_active ELSE c.is_active END AS is_active, c.created_at
        FROM customers c FULL JOIN cleaned b ON b.customer_id = c.customer_id""", "customers", "cleaned"),
    "keyword_categories": f"SELECT doc_id, {category_of('upper(text)')} AS category FROM documents",
    "retail_products": sql(
        "SELECT product_id, product_name, category, unit_price, unit_cost FROM retail_products", "retail_products"),
    "retail_customers": sql("""
        SELECT customer_id, 'Customer ' || customer_id AS name, CAST(NULL AS INTEGER) AS age, 'Unknown' AS gender,
               CAST(NULL AS VARCHAR) AS city,
               coalesce(max(country) FILTER (place = 1), 'Unknown') AS state,
               CAST(min(first) AS DATE) AS signup_date, CAST(NULL AS VARCHAR) AS email, TRUE AS is_active,
               min(first) AS created_at
        FROM retail_countries GROUP BY customer_id""", "retail_countries"),
    "retail_transactions": sql("""
        SELECT row_number() OVER (ORDER BY invoice_date, invoice, stock_code, customer_id, quantity, unit_price)
                   AS transaction_id,
               customer_id, product_id, units AS quantity, CAST(order_amount AS DOUBLE) AS order_amount,
               CAST(round(order_amount * CAST(0.65 AS DECIMAL(3,2)), 2) AS DOUBLE) AS cost_amount,
               CAST(0 AS DOUBLE) AS discount_amount, invoice_date AS order_date, 'Online' AS channel,
               CASE WHEN is_cancelled THEN 'cancelled' ELSE 'completed' END AS status
        FROM purchases""", "purchases"),
    "monthly_summary": sql("SELECT * FROM retail_monthly", "retail_monthly"),
    "retail_manifest": sql("""
        SELECT 'customers' AS "table", count(DISTINCT customer_id) AS rows, 10 AS columns FROM retail
        UNION ALL SELECT 'products', count(*), 5 FROM retail_products
        UNION ALL SELECT 'transactions', count(*), 10 FROM purchases
        UNION ALL SELECT 'monthly_summary', count(*), 4 FROM retail_monthly""", "purchases", "retail_monthly"),
    "mart_manifest": sql(f"""
        SELECT 'customer_master' AS "table", count(*) AS rows, 34 AS columns FROM customers
        UNION ALL SELECT 'monthly_revenue', count(*), 2 FROM monthly
        UNION ALL SELECT 'segments', count(DISTINCT segment), 3 FROM segmented
        UNION ALL SELECT 'geography', count(*), 3 FROM markets
        UNION ALL SELECT 'category_revenue', count(*), 2 FROM categories
        UNION ALL SELECT 'recommendations', count(*), 6 FROM ({actions('rule')})
        UNION ALL SELECT 'products', count(*), 5 FROM products""",
                         "customers", "monthly", "segmented", "markets", "categories", "ruled", "products"),
    "churn_label_split": sql("""
        SELECT customer_id, signup_date, CAST(recency_days > 90 AS INTEGER) AS churned,
               CASE WHEN row_number() OVER (ORDER BY signup_date, customer_id)
                         <= greatest(3 * (count(*) OVER ()) // 4, 1) THEN 'train' ELSE 'test' END AS part
        FROM master""", "master"),
    "churn_training_check": sql("""
        SELECT CAST(recency_days > 90 AS INTEGER) AS churned, count(*) AS customers,
               count(*) FILTER (order_count > 0) AS buyers FROM master GROUP BY 1""", "master"),
    "revenue_history": sql(f"""
        SELECT series, {month_label('month')} AS month, {rounded('revenue', 2)} AS revenue FROM series""", "series"),
    "forecast_features_by_state": sql("""
        SELECT series, month, target, lag_1, lag_2, lag_3, lag_6, rolling_3, month_number,
               CASE WHEN row_number() OVER (PARTITION BY series ORDER BY month)
                         <= greatest((count(*) OVER (PARTITION BY series))
                                     - greatest(2, (count(*) OVER (PARTITION BY series)) // 4), 1)
                    THEN 'head' ELSE 'tail' END AS part
        FROM complete""", "complete"),
    "forecast_moving_average": sql(f"""
        SELECT series, {month_label("last + to_months(CAST(step AS INTEGER))")} AS month, {rounded('value', 2)} AS forecast,
               {rounded('value * (1 - CAST(0.2 AS DOUBLE))', 2)} AS lower,
               {rounded('value * (1 + CAST(0.2 AS DOUBLE))', 2)} AS upper
        FROM averages CROSS JOIN (SELECT unnest(range(1, 7)) AS step)""", "averages"),
}

for _name, _source in {"total_history": "revenue_history", "total_forecast_features": "forecast_features_by_state",
                       "total_moving_average": "forecast_moving_average"}.items():
    ORACLE[_name] = f"SELECT * FROM ({ORACLE[_source]}) WHERE series = 'total'"

ORACLE["naive_forecast_errors"] = f"""
    SELECT series, 'previous_month' AS model, {rounded("avg(abs(target - lag_1))", 2)} AS mae,
           {rounded("sqrt(avg((target - lag_1) * (target - lag_1)))", 2)} AS rmse,
           {rounded("avg(abs((target - lag_1) / nullif(target, 0))) * 100", 2)} AS mape
    FROM ({ORACLE["forecast_features_by_state"]}) WHERE part = 'tail' GROUP BY series"""

_MEASURES = ["recency_days", "order_count", "total_revenue", "average_order_value", "campaign_response_rate"]


def _scaled(measure: str) -> str:
    log = f"ln(1 + CAST({measure} AS DOUBLE))"
    return f"coalesce(({log} - avg({log}) OVER ()) / nullif(stddev_samp({log}) OVER (), 0), 0)"


def _standardised(measure: str) -> str:
    return rounded(_scaled(measure), 5)


ORACLE["cluster_features"] = sql(f"""
    SELECT customer_id, {", ".join(f"{_standardised(name)} AS {name}" for name in _MEASURES)} FROM master""", "master")

_POINT = [f"v{i}" for i in range(len(_MEASURES))]
_SQUARE = " + ".join(f"{name} * {name}" for name in _POINT)


def _spread(group: str) -> str:
    """Sum of the squared distances from a point to all points of a group."""
    product = " + ".join(f"p.{name} * {group}.s{name}" for name in _POINT)
    return f"({group}.n * ({_SQUARE}) + {group}.q - 2 * ({product}))"


PARTS["points"] = (["segmented"], f"""
    SELECT customer_id, segment, {", ".join(f"{_scaled(name)} AS {alias}" for name, alias in zip(_MEASURES, _POINT, strict=True))}
    FROM segmented""")
PARTS["group_sums"] = (["points"], f"""
    SELECT segment, CAST(count(*) AS DOUBLE) AS n, sum({_SQUARE}) AS q, {", ".join(f"sum({name}) AS s{name}" for name in _POINT)}
    FROM points GROUP BY segment""")
PARTS["spreads"] = (["points", "group_sums"], f"""
    SELECT p.segment, p.customer_id, max(CASE WHEN g.segment = p.segment THEN g.n END) AS n,
           max(CASE WHEN g.segment = p.segment THEN greatest({_spread("g")}, 0) / nullif(g.n - 1, 0) END) AS a,
           min(CASE WHEN g.segment <> p.segment THEN {_spread("g")} / g.n END) AS b
    FROM points p, group_sums g GROUP BY p.segment, p.customer_id""")
ORACLE["segment_silhouette"] = sql(f"""
    SELECT segment, count(*) AS customers,
           {rounded("avg(CASE WHEN n = 1 THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END)", 4)} AS silhouette
    FROM spreads GROUP BY segment""", "spreads")

PARTS["judged"] = (["service", "behavioral"], """
    SELECT model_name, CAST(recency_days > 90 AS INTEGER) AS churned, churn_probability
    FROM (SELECT 'service' AS model_name, * FROM service UNION ALL SELECT 'behavioral', * FROM behavioral)
    JOIN (SELECT customer_id, recency_days FROM master) USING (customer_id)""")
PARTS["score_ranks"] = (["judged"], """
    SELECT *, churn_probability >= 0.5 AS hit, rank() OVER (PARTITION BY model_name ORDER BY churn_probability)
              + (count(*) OVER (PARTITION BY model_name, churn_probability) - 1) / CAST(2 AS DOUBLE) AS place
    FROM judged""")
PARTS["outcomes"] = (["score_ranks"], """
    SELECT model_name, CAST(count(*) FILTER (churned = 1 AND hit) AS DOUBLE) AS tp,
           CAST(count(*) FILTER (churned = 0 AND hit) AS DOUBLE) AS fp,
           CAST(count(*) FILTER (churned = 1 AND NOT hit) AS DOUBLE) AS fn,
           CAST(count(*) FILTER (churned = 0 AND NOT hit) AS DOUBLE) AS tn, sum(place) FILTER (churned = 1) AS places
    FROM score_ranks GROUP BY model_name""")
PARTS["measured"] = (["outcomes"], f"""
    SELECT model_name, {rounded("(tp + tn) / (tp + fp + fn + tn)", 4)} AS accuracy,
           {rounded("coalesce(tp / nullif(tp + fp, 0), 0)", 4)} AS precision,
           {rounded("coalesce(tp / nullif(tp + fn, 0), 0)", 4)} AS recall,
           {rounded("coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)", 4)} AS f1,
           {rounded("(places - (tp + fn) * (tp + fn + 1) / 2) / nullif((tp + fn) * (fp + tn), 0)", 4)} AS roc_auc
    FROM outcomes""")
PARTS["selection"] = (["measured"], """
    SELECT *, row_number() OVER (ORDER BY roc_auc DESC NULLS LAST, model_name) = 1 AS selected FROM measured""")
ORACLE["churn_metrics"] = sql("SELECT * FROM selection", "selection")
ORACLE["model_runs"] = sql("""
    SELECT 'churn' AS model_type, (SELECT model_name FROM selection WHERE selected) AS selected_model, model_name, metric,
           value, true AS well_formed
    FROM (SELECT model_name, accuracy, precision, recall, f1, roc_auc FROM selection)
    UNPIVOT (value FOR metric IN (accuracy, precision, recall, f1, roc_auc))""", "selection")

ORACLE["random_split"] = f"""
    SELECT c_custkey AS customer_id, n_name AS state,
           CASE WHEN CAST('0x' || substr(md5('{MODEL_SEED}:' || c_custkey), 1, 8) AS BIGINT) < {int(TRAIN_SHARE * 16 ** 8)}
                THEN 'train' ELSE 'test' END AS part
    FROM customer JOIN nation ON n_nationkey = c_nationkey"""

PARTS["parted"] = (["master"], """
    SELECT *, row_number() OVER (ORDER BY signup_date NULLS LAST, customer_id)
              <= greatest(3 * (count(*) OVER ()) // 4, 1) AS train FROM master""")
PARTS["imputed"] = (["parted"], f"""
    SELECT p.customer_id, p.train, p.gender, p.state,
           {", ".join(f"coalesce(CAST(p.{name} AS DOUBLE), m.{name}, 0) AS {name}" for name in NUMERIC)}
    FROM parted p, (SELECT {", ".join(f"median(CAST({name} AS DOUBLE)) FILTER (train) AS {name}" for name in NUMERIC)}
                    FROM parted) m""")


def _train_scaled(name: str) -> str:
    mean, deviation = (f"(SELECT {pick}({name}) FILTER (train) FROM imputed)" for pick in ("avg", "stddev_samp"))
    return rounded(f"coalesce((i.{name} - {mean}) / nullif({deviation}, 0), 0)", 5)


def _codes(name: str) -> str:
    """A join that gives the number of a text among those of the training rows."""
    seen = f"FROM parted WHERE train AND {name} IS NOT NULL"
    mode = f"(SELECT {name} {seen} GROUP BY {name} ORDER BY count(*) DESC, {name} LIMIT 1)"
    return f"""LEFT JOIN (SELECT {name} AS text, row_number() OVER (ORDER BY {name}) - 1 AS code
                          FROM (SELECT DISTINCT {name} {seen})) {name}_codes
               ON {name}_codes.text = coalesce(i.{name}, {mode}, 'Unknown')"""


ORACLE["churn_features"] = sql(f"""
    SELECT i.customer_id, {", ".join(f"{_train_scaled(name)} AS {name}" for name in NUMERIC)},
           {", ".join(f"""CAST(coalesce({name}_codes.code, (SELECT count(DISTINCT {name}) FROM parted WHERE train))
                          AS INTEGER) AS {name}_code""" for name in CATEGORICAL)}
    FROM imputed i {" ".join(map(_codes, CATEGORICAL))}""", "imputed")

ORACLE["clean_written_customers"] = f"""
    SELECT c_custkey AS customer_id,
           CASE c_custkey % 7 WHEN 0 THEN 'Ann "Q" ' || {title("c_name")} WHEN 1 THEN 'Two' || chr(10) || 'Lines, ' || {title("c_name")}
                ELSE {title("c_name")} END AS name,
           CASE WHEN c_custkey % 11 > 1 THEN {title("n_name")} END AS state,
           DATE '1995-01-01' + CAST(c_custkey % 1000 AS INTEGER) AS signup_date, c_custkey % 3 <> 0 AS is_active
    FROM customer JOIN nation ON n_nationkey = c_nationkey"""

ORACLE["retail_in_file_order"] = sql("""
    SELECT row_number() OVER (ORDER BY is_cancelled, CAST(invoice_date AS VARCHAR), invoice, stock_code,
               CAST(customer_id AS VARCHAR), CAST(CAST(quantity AS INTEGER) AS VARCHAR),
               CAST(CAST(unit_price AS DECIMAL(18,2)) AS VARCHAR)) AS transaction_id,
           customer_id, units AS quantity, CAST(order_amount AS DOUBLE) AS order_amount, invoice_date AS order_date,
           CASE WHEN is_cancelled THEN 'cancelled' ELSE 'completed' END AS status
    FROM purchases""", "purchases")

ORACLE["ingest_job"] = f"""
    SELECT c_custkey AS customer_id, CASE WHEN c_custkey % 3 = 0 THEN 'New ' ELSE '' END || {title("c_name")} AS name,
           CASE WHEN c_custkey % 2 = 0 THEN c_custkey || '@example.com' END AS email,
           DATE '2020-02-03' AS signup_date, true AS is_active
    FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0"""

ORACLE["ingest_second_run"] = f"""
    SELECT coalesce(l.c_custkey, f.customer_id) AS customer_id,
           coalesce(l.name, f.name) AS name, f.email, coalesce(l.signup_date, f.signup_date) AS signup_date, true AS is_active
    FROM ({ORACLE["ingest_job"]}) f FULL JOIN (
        SELECT c_custkey, {title("c_name")} AS name, DATE '2021-07-08' AS signup_date FROM customer WHERE c_custkey % 5 = 0
    ) l ON l.c_custkey = f.customer_id"""

ORACLE["ingest_counts"] = """
    WITH loads AS (
        SELECT count(*) FILTER (c_custkey % 2 = 0) AS n, 4 AS columns FROM customer
        UNION ALL SELECT count(*) FILTER (c_custkey % 3 = 0), 3 FROM customer)
    SELECT n AS row_count, unnest(['rows_received', 'rows_standardized', 'duplicates_removed', 'columns', 'missing_values',
                                   'invalid_customer_id', 'invalid_name', 'invalid_signup_date']) AS metric,
           unnest([n, n, 0, columns, 0, 0, 0, 0]) AS value
    FROM loads"""

ORACLE["text_batches"] = """
    WITH texts AS (
        SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS file_name, sha256(text) AS checksum, source
        FROM documents WHERE text IS NOT NULL),
    ledger AS (
        SELECT checksum, count(*) AS n FROM texts WHERE source = (SELECT min(source) FROM texts) GROUP BY checksum)
    SELECT file_name, t.checksum,
           CASE WHEN n IS NULL THEN substr(t.checksum, 1, 32) ELSE substr(t.checksum, 33, 32) END AS batch_id,
           CASE WHEN n IS NULL AND file_name = min(file_name) OVER (PARTITION BY t.checksum) THEN 'completed'
                ELSE 'duplicate' END AS status,
           n AS rows_loaded
    FROM texts t LEFT JOIN ledger USING (checksum)"""

ORACLE["ingest_outcome"] = """
    SELECT 'a' AS batch, 'completed' AS status, count(*) FILTER (c_custkey % 2 = 0) AS rows_loaded FROM customer
    UNION ALL SELECT 'b', 'completed', count(*) FILTER (c_custkey % 3 = 0) FROM customer
    UNION ALL SELECT 'c', 'duplicate', count(*) FILTER (c_custkey % 3 = 0) FROM customer"""

for _member, _alone in {"dataset": "dataset_header", "kpis": "executive_kpis", "segments": "segment_rollup",
                        "geography": "geography", "monthly_revenue": "monthly_revenue",
                        "category_revenue": "category_revenue"}.items():
    ORACLE[f"dashboard_{_member}"] = ORACLE[_alone]

ORACLE["payload_months"] = ORACLE["stored_tables_months"] = ORACLE["monthly_revenue"]
ORACLE["payload_segments"] = ORACLE["segment_rollup"]
ORACLE["mart_customers"] = f"""
    SELECT customer_id, c.name, s.segment, CAST(c.clv_rank AS INTEGER) AS clv_rank
    FROM ({ORACLE["clv_ranked"]}) c JOIN ({ORACLE["segment_listing"]}) s USING (customer_id)"""

_KPIS = ["customers", "active_customers", "revenue", "profit", "churn_rate", "retention_rate", "average_order_value",
         "campaign_conversion_rate", "customer_health_score", "revenue_growth_pct", "margin_pct"]
_HEADER = ["transactions", "products", "customers", "markets"]


def _fields(member: str, numbers: list[str], texts: list[str]) -> str:
    return " UNION ALL ".join(
        [f"""SELECT '{member}' AS member, 0 AS place, '{name}' AS label, NULL AS detail, CAST(NULL AS BIGINT) AS number,
             CAST({name} AS DOUBLE) AS amount FROM {member}""" for name in numbers]
        + [f"SELECT '{member}', 0, '{name}', {name}, NULL, NULL FROM {member}" for name in texts])


_DICTIONARY = ", ".join(f"({place}, '{name}', '{text}')" for place, (name, text, _) in enumerate(DATA_DICTIONARY))
ORACLE["payload_members"] = f"""
    WITH kpis AS ({ORACLE["executive_kpis"]}), dataset AS ({ORACLE["dataset_header"]}), places AS ({ORACLE["top_markets"]}),
    kinds AS ({ORACLE["category_revenue"]}), queue AS ({ORACLE["action_queue_top100"]})
    {_fields("dataset", _HEADER, ["source", "date_start", "date_end"])}
    UNION ALL {_fields("kpis", _KPIS, ["top_segment"])}
    UNION ALL SELECT 'geography', CAST(row_number() OVER (ORDER BY revenue DESC, state) - 1 AS INTEGER), state, NULL, customers,
                     revenue FROM places
    UNION ALL SELECT 'categories', CAST(row_number() OVER (ORDER BY order_amount DESC, category) - 1 AS INTEGER), category,
                     NULL, NULL, order_amount FROM kinds
    UNION ALL SELECT 'recommendations', CAST(row_number() OVER ({QUEUE}) - 1 AS INTEGER), action, reason, customer_id,
                     expected_value FROM queue
    UNION ALL SELECT 'data_dictionary', place, label, detail, NULL, NULL
              FROM (VALUES {_DICTIONARY}) AS d(place, label, detail)"""
ORACLE["segmented_rows"] = sql("""
    SELECT customer_id, CAST(order_count AS BIGINT) AS order_count, CAST(recency_days AS BIGINT) AS recency_days,
           CAST(rfm_score AS BIGINT) AS rfm_score, name, segment, total_revenue FROM segmented""", "segmented")
