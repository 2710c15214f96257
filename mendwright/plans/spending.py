"""Queries on spend, expiry and alerts, bound to orders, lineitem and customer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mendwright.functions.expr import elapsed_days, iso_date
from mendwright.operators import expiry, spend
from mendwright.plans.base import query, table

AS_OF = "2001-07-31 12:00:00"
EXPIRY_AS_OF = "2001-10-15 12:00:00"
# Labels of the order priorities, which stand in for spend categories.
LABELS = {"1-URGENT": "Urgent", "2-HIGH": "High", "3-MEDIUM": "Normal", "4-NOT SPECIFIED": "Other", "5-LOW": "Other"}
LABEL_SQL = "CASE o_orderpriority WHEN '1-URGENT' THEN 'Urgent' WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'Normal' WHEN '4-NOT SPECIFIED' THEN 'Other' WHEN '5-LOW' THEN 'Other' ELSE o_orderpriority END"
MONEY = "COALESCE(TRY_CAST(o_totalprice AS DECIMAL(12,2)), 0)"


def _date() -> Column:
    return F.col("o_orderdate")


def _now() -> Column:
    return F.lit(EXPIRY_AS_OF).cast("timestamp_ntz")


def _ship() -> Column:
    return F.col("l_shipdate")


def label() -> Column:
    return spend.relabelled(F.col("o_orderpriority"), LABELS)


@query(f"SELECT CAST(COALESCE(SUM({MONEY}), 0) AS DOUBLE) AS total, COUNT(*) AS records FROM orders")
def total_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spend.total(table(spark, sf_dir, "orders"), "o_totalprice")


@query(f"SELECT CAST(COALESCE(SUM({MONEY}), 0) AS DOUBLE) AS month_total FROM orders WHERE date_trunc('month', o_orderdate) = DATE '2001-07-01'")
def month_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spend.month_total(table(spark, sf_dir, "orders"), "o_totalprice", _date(), AS_OF)


def _series_sql(bound: str) -> str:
    return f"""WITH spine AS (SELECT CAST(DATE '2000-08-01' + INTERVAL (i) MONTH AS DATE) AS month FROM range(12) t(i)),
    s AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, SUM({MONEY}) AS s FROM orders WHERE o_orderdate >= DATE '2000-08-01' AND o_orderdate {bound} GROUP BY 1)
    SELECT spine.month, strftime(spine.month, '%m/%y') AS label, CAST(COALESCE(s, 0) AS DOUBLE) AS total, CAST(floor(CAST(COALESCE(s, 0) AS DOUBLE) + 0.5) AS BIGINT) AS rounded FROM spine LEFT JOIN s USING (month)"""


BOUNDED = _series_sql(f"<= TIMESTAMP '{AS_OF}'")


@query(BOUNDED)
def monthly_series_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spend.monthly_series(table(spark, sf_dir, "orders"), "o_totalprice", _date(), AS_OF)


@query(_series_sql("< DATE '2001-08-01'"))
def monthly_series_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spend.monthly_series(table(spark, sf_dir, "orders"), "o_totalprice", _date(), AS_OF, until_now=False)


@query(f"SELECT ROUND(SUM(total) / 12, 4) AS average FROM ({BOUNDED})")
def avg_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spend.monthly_average(table(spark, sf_dir, "orders"), "o_totalprice", _date(), AS_OF).select(F.round("average", 4).alias("average"))


CATEGORY = f"SELECT {LABEL_SQL} AS category, CAST(SUM({MONEY}) AS DOUBLE) AS total, COUNT(*) AS records FROM orders GROUP BY 1"


@query(CATEGORY)
def spend_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spend.by_category(table(spark, sf_dir, "orders"), "o_totalprice", label())


@query(f"SELECT * FROM ({CATEGORY}) WHERE total > 0")
def category_breakdown_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spend.by_category(table(spark, sf_dir, "orders"), "o_totalprice", label(), positive_only=True)


@query(f"SELECT category, total, records, ROUND(total / SUM(total) OVER (), 6) AS share FROM ({CATEGORY})")
def analytics_category_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spend.category_shares(table(spark, sf_dir, "orders"), "o_totalprice", label())


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY COALESCE(o_orderdate, TIMESTAMP '1970-01-01') DESC, o_orderkey LIMIT 6")
def recent_top6(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return spend.recent(orders, 6, _date(), _date(), "o_orderkey")


@query("SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spend.latest_per_owner(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"), "o_custkey", "o_orderdate", "o_orderkey")


SEARCH = f"""SELECT o_orderkey, c_name || ' (' || c_mktsegment || ')' AS owner, {LABEL_SQL} AS category, o_orderdate, CAST({MONEY} AS DOUBLE) AS amount
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey
    WHERE {LABEL_SQL} = 'Urgent' AND CAST(o_orderdate AS DATE) BETWEEN DATE '2001-01-01' AND DATE '2001-06-30' AND contains(lower(concat_ws(' ', o_orderpriority, {LABEL_SQL})), 'urg')"""


def _search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters before the join: category, both dates inclusive, free text; then the owner's label."""
    orders = table(spark, sf_dir, "orders").withColumn("category", label())
    day = F.to_date("o_orderdate")
    found = orders.where((F.col("category") == "Urgent") & day.between("2001-01-01", "2001-06-30") & F.contains(F.lower(F.concat_ws(" ", "o_orderpriority", "category")), F.lower(F.trim(F.lit(" URG ")))))
    owners = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.concat("c_name", F.lit(" ("), "c_mktsegment", F.lit(")")).alias("owner"))
    return found.join(owners, "o_custkey", "left").select("o_orderkey", "owner", "category", "o_orderdate", spend.money(F.col("o_totalprice")).cast("double").alias("amount"))


@query(SEARCH)
def expense_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir).orderBy(F.desc("o_orderdate"), "o_orderkey")


@query(f"SELECT ROUND(SUM(amount), 2) AS total, COUNT(*) AS records FROM ({SEARCH})")
def expense_search_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir).agg(F.round(F.sum("amount"), 2).alias("total"), F.count("*").alias("records"))


# expiry: shipping dates stand in for the dates that run out
DIFF = f"date_diff('day', CAST(TIMESTAMP '{EXPIRY_AS_OF}' AS DATE), CAST(l_shipdate AS DATE))"
CLASS = f"CASE WHEN l_shipdate IS NULL THEN 'none' WHEN {DIFF} < 0 THEN 'expired' WHEN {DIFF} <= 30 THEN 'expiring' ELSE 'valid' END"
ELAPSED = f"CAST(floor((epoch_ms(l_shipdate) - epoch_ms(TIMESTAMP '{EXPIRY_AS_OF}')) / 86400000.0 + 0.5) AS BIGINT)"
STATUS = f"CASE WHEN l_shipdate IS NULL THEN 'none' WHEN {ELAPSED} < 0 THEN 'expired' WHEN {ELAPSED} <= 30 THEN 'expiring' ELSE 'ok' END"


@query(f"SELECT {CLASS} AS class, COUNT(*) AS n FROM lineitem GROUP BY 1")
def expiry_class_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(expiry.calendar_class(_ship(), _now()).alias("class")).agg(F.count("*").alias("n"))


@query(f"SELECT CASE WHEN l_shipdate IS NULL THEN '-' WHEN {DIFF} < 0 THEN 'Expired' ELSE 'OK' END AS pill, COUNT(*) AS n FROM lineitem GROUP BY 1")
def expiry_pill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(expiry.pill(_ship(), _now()).alias("pill")).agg(F.count("*").alias("n"))


@query(f"SELECT {STATUS} AS status, MIN({ELAPSED}) AS low, MAX({ELAPSED}) AS high, COUNT(*) AS n FROM lineitem GROUP BY 1")
def expiry_elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = elapsed_days(_ship(), _now())
    return table(spark, sf_dir, "lineitem").groupBy(expiry.elapsed_class(_ship(), _now()).alias("status")).agg(F.min(d).alias("low"), F.max(d).alias("high"), F.count("*").alias("n"))


# Days from an order's date to the three dates that run out.
OFFSETS = {"insurance": 100, "roadtax": 80, "service": 60}


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = {k: (_date() + F.expr(f"interval {n} days")).alias(f"{k}_date") for k, n in OFFSETS.items()}
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", *days.values())


RECORDS = "(SELECT o_orderkey, o_custkey, " + ", ".join(f"o_orderdate + INTERVAL {n} DAY AS {k}_date" for k, n in OFFSETS.items()) + " FROM orders) r"


def _elapsed(c: str) -> str:
    return f"CAST(floor((epoch_ms({c}) - epoch_ms(TIMESTAMP '{EXPIRY_AS_OF}')) / 86400000.0 + 0.5) AS BIGINT)"


DASHBOARD = " UNION ALL ".join(
    f"SELECT o_orderkey, '{k}' AS kind, CASE WHEN {_elapsed(f'{k}_date')} < 0 THEN 'expired' ELSE 'expiring' END AS status, abs({_elapsed(f'{k}_date')}) AS days, strftime({k}_date, '%Y-%m-%d') AS due FROM {RECORDS} WHERE {_elapsed(f'{k}_date')} <= 30"
    for k in OFFSETS
)


def _dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expiry.dashboard_alerts(_records(spark, sf_dir), "o_orderkey", {k: f"{k}_date" for k in OFFSETS}, _now())


@query(DASHBOARD)
def alerts_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dashboard(spark, sf_dir)


@query(f"SELECT o_orderkey, kind, status, days, due FROM ({DASHBOARD}) ORDER BY CASE status WHEN 'expired' THEN 0 ELSE 1 END, days, o_orderkey, kind LIMIT 4")
def renewals_top4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dashboard(spark, sf_dir).orderBy(F.when(F.col("status") == "expired", 0).otherwise(1), "days", "o_orderkey", "kind").limit(4)


TIP = "Steady speed saves fuel."


def _diff(c: str) -> str:
    return f"date_diff('day', CAST(TIMESTAMP '{EXPIRY_AS_OF}' AS DATE), CAST({c} AS DATE))"


SMART = " UNION ALL ".join(
    f"""SELECT '{k}-' || o_orderkey || '-' || strftime({k}_date, '%Y-%m-%d') AS id, '{k}' AS kind, CASE WHEN {_diff(f'{k}_date')} < 0 THEN '{expiry.PRIORITIES[k][0]}' ELSE '{expiry.PRIORITIES[k][1]}' END AS priority,
    '{k}' || CASE WHEN {_diff(f'{k}_date')} < 0 THEN ' expired' ELSE ' due' END AS title,
    'Order ' || o_orderkey || CASE WHEN {_diff(f'{k}_date')} < 0 THEN ': ' || (-{_diff(f'{k}_date')}) || ' days ago' ELSE ': in ' || {_diff(f'{k}_date')} || ' days' END AS message, strftime({k}_date, '%Y-%m-%d') AS due
    FROM {RECORDS} WHERE {_diff(f'{k}_date')} <= 30"""
    for k in OFFSETS
) + f" UNION ALL SELECT 'tip-2001-10-15', 'tip', 'low', 'tip', '{TIP}', '2001-10-15'"


def _smart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expiry.smart_alerts(_records(spark, sf_dir), "o_orderkey", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), {k: f"{k}_date" for k in OFFSETS}, _now(), TIP)


@query(SMART)
def alerts_smart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _smart(spark, sf_dir)


@query(f"SELECT id, priority, title FROM ({SMART}) ORDER BY CASE priority WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, title, id LIMIT 50")
def alerts_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _smart(spark, sf_dir).select("id", "priority", "title").orderBy(expiry.priority_weight(F.col("priority")).desc(), "title", "id").limit(50)


# every third record's insurance alert was dismissed, on days around as_of
DISMISSED = f"(SELECT 'insurance-' || o_orderkey || '-' || strftime(insurance_date, '%Y-%m-%d') AS id, TIMESTAMP '{EXPIRY_AS_OF}' + INTERVAL 1 DAY * (o_orderkey % 9 - 4) AS until FROM {RECORDS} WHERE o_orderkey % 3 = 0)"


def _dismissed(spark: SparkSession, sf_dir: str) -> DataFrame:
    until = (_now().cast("timestamp") + F.make_dt_interval((F.col("o_orderkey") % 9 - 4).cast("int"))).cast("timestamp_ntz")
    own = _records(spark, sf_dir).where("o_orderkey % 3 = 0")
    return own.select(F.concat_ws("-", F.lit("insurance"), F.col("o_orderkey").cast("string"), iso_date(F.col("insurance_date"))).alias("id"), until.alias("until"))


@query(f"SELECT * FROM ({SMART}) a WHERE NOT EXISTS (SELECT 1 FROM {DISMISSED} d WHERE d.id = a.id AND d.until > TIMESTAMP '{EXPIRY_AS_OF}')")
def alerts_after_dismiss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expiry.not_dismissed(_smart(spark, sf_dir), _dismissed(spark, sf_dir), _now())


@query(f"""WITH d AS (SELECT * FROM {DISMISSED}), n AS (SELECT DISTINCT id FROM ({SMART}) WHERE priority = 'high')
    SELECT id, until FROM d WHERE until > TIMESTAMP '{EXPIRY_AS_OF}' AND id NOT IN (SELECT id FROM n) UNION ALL SELECT id, TIMESTAMP '{EXPIRY_AS_OF}' + INTERVAL 7 DAY FROM n""")
def dismissals_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expiry.dismiss(_dismissed(spark, sf_dir), _smart(spark, sf_dir).where("priority = 'high'").select("id"), _now())


@query(f"SELECT CAST(count_if(priority = 'high') AS BIGINT) AS high, CAST(count_if(priority = 'medium') AS BIGINT) AS medium, CAST(count_if(priority = 'low') AS BIGINT) AS low, COUNT(*) AS total, CAST(count_if(priority IN ('high', 'medium')) AS BIGINT) AS actions FROM ({SMART})")
def alert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expiry.priority_counts(_smart(spark, sf_dir))


@query(f"""SELECT (SELECT COUNT(*) FROM customer) AS records, (SELECT CAST(COALESCE(SUM({MONEY}), 0) AS DOUBLE) FROM orders WHERE date_trunc('month', o_orderdate) = DATE '2001-07-01') AS month_total,
    (SELECT ROUND(SUM(total) / 12, 4) FROM ({BOUNDED})) AS average, (SELECT COUNT(*) FROM ({DASHBOARD}) WHERE status = 'expired') AS high, (SELECT COUNT(*) FROM ({DASHBOARD}) WHERE status = 'expiring') AS medium""")
def dashboard_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row; each part is an aggregate of one row, so the joins are of one row with one."""
    orders = table(spark, sf_dir, "orders")
    parts = [
        table(spark, sf_dir, "customer").agg(F.count("*").alias("records")),
        spend.month_total(orders, "o_totalprice", _date(), AS_OF),
        spend.monthly_average(orders, "o_totalprice", _date(), AS_OF).select(F.round("average", 4).alias("average")),
        _dashboard(spark, sf_dir).agg(F.count_if(F.col("status") == "expired").alias("high"), F.count_if(F.col("status") == "expiring").alias("medium")),
    ]
    out = parts[0].withColumn("one", F.lit(1))
    for p in parts[1:]:
        out = out.join(p.withColumn("one", F.lit(1)), "one")
    return out.drop("one")


@query("SELECT CAST(ts AS DATE) AS day, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2")
def event_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's daily counts over a table."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), "event_type", "n")


STORED = "['Fuel', 'Maintenance', 'Service', 'Parts', 'Insurance', 'RoadTax', 'Tax', 'Toll_Parking', 'Toll', 'General', 'Other', 'Unheard'][o_orderkey % 12 + 1]"


@query(f"""SELECT CASE WHEN c IN ('Service', 'Parts') THEN 'Maintenance' WHEN c IN ('RoadTax', 'Tax') THEN 'Road Tax' WHEN c IN ('Toll_Parking', 'Toll') THEN 'Toll/Parking' WHEN c IN ('General', 'Unheard') THEN 'Other' ELSE c END AS category,
    CAST(SUM({MONEY}) AS DOUBLE) AS total, COUNT(*) AS n FROM (SELECT *, {STORED} AS c FROM orders) GROUP BY 1""")
def stored_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spend by shown category: stored values with older aliases."""
    names = F.array(*[F.lit(c) for c in [*spend.CATEGORY_LABELS, "Unheard"]])
    stored = F.element_at(names, (F.col("o_orderkey") % 12 + 1).cast("int"))
    shown = spend.relabelled(stored, spend.CATEGORY_LABELS, "Other")
    return table(spark, sf_dir, "orders").groupBy(shown.alias("category")).agg(F.sum(spend.money(F.col("o_totalprice"))).cast("double").alias("total"), F.count("*").alias("n"))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 2")
def first_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each owner's first two records in the order of the server."""
    return spend.first_records(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", 2).select("o_custkey", "o_orderkey")


@query(f"""SELECT d AS class, COUNT(*) AS n FROM (SELECT CASE WHEN l_shipdate IS NULL THEN 'none' WHEN x < 0 THEN 'expired' WHEN x <= 30 THEN 'expiring' ELSE 'valid' END AS d
    FROM (SELECT *, date_diff('day', CAST(TIMESTAMP '2000-03-15 09:30:00' AS DATE), CAST(l_shipdate AS DATE)) AS x FROM (SELECT CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_shipdate END AS l_shipdate FROM lineitem))) GROUP BY 1""")
def expiry_every_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day amid the data, and dates that are missing."""
    date = F.when(F.col("l_linenumber") % 5 != 0, _ship())
    return table(spark, sf_dir, "lineitem").groupBy(expiry.calendar_class(date, F.lit("2000-03-15 09:30:00").cast("timestamp_ntz")).alias("class")).agg(F.count("*").alias("n"))
