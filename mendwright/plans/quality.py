"""Queries on cleaning, year validation and rules, bound to orders, part, customer and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendwright.functions.expr import currency, kilometres, midnight_text, number_prefix, progress, shortened, size_label, uri_part
from mendwright.operators import rules, similarity, years
from mendwright.plans.base import query, table

# year texts with planted faults, by order key
YEARS = """CASE o_orderkey % 17 WHEN 0 THEN '20' || (26 + o_orderkey % 5) WHEN 1 THEN '2o' || (10 + o_orderkey % 20) WHEN 2 THEN 'l9' WHEN 3 THEN CAST(o_orderkey % 100 AS STRING) WHEN 4 THEN '202' WHEN 5 THEN '203'
    WHEN 6 THEN ' 2024 ' WHEN 7 THEN '2024.0' WHEN 8 THEN 'abc' WHEN 9 THEN '' WHEN 10 THEN NULL WHEN 11 THEN '1850' WHEN 12 THEN '1979' WHEN 13 THEN '99999999999' WHEN 14 THEN '202B' WHEN 15 THEN '2O3o'
    ELSE CAST(1980 + o_orderkey % 46 AS STRING) END"""
INPUTS = f"(SELECT o_orderkey, {YEARS.replace('STRING', 'VARCHAR')} AS y FROM orders)"
CLEANED = f"""(SELECT *, regexp_replace(split_part(regexp_replace(COALESCE(y, ''), '^\\s+|\\s+$', '', 'g'), '.', 1), '[^0-9oOlI]', '', 'g') AS s FROM {INPUTS})"""
FORMAT = f"""(SELECT *, translate(s, 'oOlI', '0011') AS t, CASE WHEN regexp_full_match(translate(s, 'oOlI', '0011'), '[0-9]{{2}}') THEN CAST(translate(s, 'oOlI', '0011') AS INTEGER) END AS two FROM {CLEANED})"""
FIXED = f"""(SELECT *, CASE WHEN two >= 80 THEN '19' || t WHEN two <= 30 THEN '20' || t WHEN t IN ('200', '201', '202') THEN t || '0' ELSE t END AS f,
    CASE WHEN two >= 80 OR two <= 30 THEN 0.8 WHEN t IN ('200', '201', '202') THEN 0.7 WHEN regexp_matches(s, '[oOlI]') THEN 0.9 ELSE 1.0 END AS fc,
    CASE WHEN two >= 80 THEN 'century_completion_1900s' WHEN two <= 30 THEN 'century_completion_2000s' WHEN t IN ('200', '201', '202') THEN 'year_completion' WHEN regexp_matches(s, '[oOlI]') THEN 'ocr_correction' ELSE '' END AS fr FROM {FORMAT})"""
RANGED = f"""(SELECT *, TRY_CAST(f AS HUGEINT) AS n FROM {FIXED})"""
JUDGED = f"""(SELECT *, CASE WHEN n > 2025 OR n < 1900 THEN '2025' ELSE f END AS r, CASE WHEN n > 2025 THEN 1.0 WHEN n < 1900 THEN 0.8 WHEN n < 1980 THEN 0.9 ELSE 1.0 END AS rc,
    CASE WHEN n > 2025 THEN 'future_year_corrected_to_2025' WHEN n < 1900 THEN 'invalid_old_year_corrected_to_2025' WHEN n < 1980 THEN 'old_year_accepted' ELSE '' END AS rr FROM {RANGED})"""
VALIDATION = f"""SELECT o_orderkey, COALESCE(y, '') AS year_original, CASE WHEN s = '' THEN '' WHEN COALESCE(y, '') <> r AND least(fc, rc) >= 0.7 THEN r ELSE COALESCE(y, '') END AS year_validated,
    s <> '' AND COALESCE(y, '') <> r AND least(fc, rc) >= 0.7 AS year_correction_applied, CAST(CASE WHEN s = '' THEN 0 ELSE least(fc, rc) END AS DOUBLE) AS year_confidence,
    CASE WHEN s = '' THEN 'empty_or_invalid_input' WHEN fr = '' AND rr = '' THEN 'no_correction_needed' WHEN fr = '' THEN rr WHEN rr = '' THEN fr ELSE fr || '+' || rr END AS year_correction_reason FROM {JUDGED}"""


def _inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr(YEARS).alias("year"))


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return years.validated(_inputs(spark, sf_dir), "year").drop("year")


@query(VALIDATION)
def year_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validated(spark, sf_dir)


@query(f"""SELECT COUNT(*) AS total, CAST(count_if(year_correction_applied) AS BIGINT) AS corrected, ROUND(count_if(year_correction_applied) / COUNT(*), 6) AS rate, ROUND(AVG(CASE WHEN year_confidence > 0 THEN year_confidence END), 6) AS mean_confidence,
    CAST(count_if(contains(year_correction_reason, 'future_year_corrected')) AS BIGINT) AS future, CAST(count_if(contains(year_correction_reason, 'ocr') OR contains(year_correction_reason, 'completion')) AS BIGINT) AS repaired FROM ({VALIDATION})""")
def year_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return years.report(_validated(spark, sf_dir), "year")


@query(f"SELECT year_correction_reason AS reason, COUNT(*) AS n FROM ({VALIDATION}) GROUP BY 1")
def year_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return years.reasons(_validated(spark, sf_dir), "year")


# the validated year, and the master's most similar one above 0.7 by edit distance, ties to the larger
ENHANCED = f"""(WITH v AS ({VALIDATION}), c AS (SELECT DISTINCT year_validated AS t FROM v WHERE year_correction_applied), m AS (SELECT DISTINCT CAST(1980 + p_size AS VARCHAR) AS candidate FROM part),
    s AS (SELECT t, candidate, 1 - levenshtein(t, candidate) / CAST(greatest(length(t), length(candidate), 1) AS DOUBLE) AS c FROM c, m),
    b AS (SELECT t, candidate, c FROM s WHERE c >= 0.6 QUALIFY row_number() OVER (PARTITION BY t ORDER BY c DESC, candidate DESC) = 1),
    n AS (SELECT * FROM b WHERE c > 0.7 AND candidate <> t)
    SELECT o_orderkey AS key, year_original, CASE WHEN year_correction_applied THEN COALESCE(candidate, year_validated) ELSE year_original END AS final_year,
    CASE WHEN NOT year_correction_applied THEN '' WHEN candidate IS NULL THEN 'year_validation' ELSE 'year_validation,autocorrect' END AS methods,
    CAST(CASE WHEN NOT year_correction_applied THEN 1 ELSE least(year_confidence, COALESCE(c, 1)) END AS DOUBLE) AS confidence, year_correction_reason FROM v LEFT JOIN n ON year_correction_applied AND t = year_validated)"""


def _enhanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    master = table(spark, sf_dir, "part").select((1980 + F.col("p_size")).cast("string").alias("candidate"))
    return similarity.enhanced_years(_inputs(spark, sf_dir).withColumnRenamed("o_orderkey", "key"), master, score=similarity.levenshtein_score, reverse=False)


@query(f"SELECT key, year_original, final_year, methods, ROUND(confidence, 6) AS confidence FROM {ENHANCED}")
def enhanced_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _enhanced(spark, sf_dir).select("key", "year_original", "final_year", "methods", F.round("confidence", 6).alias("confidence"))


@query(f"""SELECT *, ROUND((validation_corrections + autocorrect_corrections) / total_records, 6) AS correction_rate, ROUND(future_years_corrected / total_records, 6) AS future_rate FROM (SELECT COUNT(*) AS total_records,
    CAST(count_if(methods <> '' AND contains(year_correction_reason, 'future_year_corrected')) AS BIGINT) AS future_years_corrected, CAST(count_if(methods <> '') AS BIGINT) AS validation_corrections, CAST(count_if(contains(methods, 'autocorrect')) AS BIGINT) AS autocorrect_corrections, CAST(count_if(methods = '') AS BIGINT) AS no_corrections FROM {ENHANCED})""")
def enhanced_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.enhanced_statistics(_enhanced(spark, sf_dir))


@query(f"""SELECT o_orderkey, CASE WHEN c BETWEEN 1900 AND 2030 THEN c END AS year FROM (SELECT o_orderkey, CASE WHEN i BETWEEN 0 AND 49 THEN i + 2000 WHEN i BETWEEN 50 AND 99 THEN i + 1900 ELSE i END AS c
    FROM (SELECT o_orderkey, CASE WHEN abs(TRY_CAST(y AS DOUBLE)) < 2000000000 THEN CAST(trunc(TRY_CAST(y AS DOUBLE)) AS INTEGER) END AS i FROM {INPUTS}))""")
def year_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inputs(spark, sf_dir).select("o_orderkey", years.match_year(F.col("year")).alias("year"))


@query("SELECT DISTINCT trim(lower(p_brand)) AS brand, trim(lower(p_type)) AS type, CAST(CASE WHEN p_size BETWEEN 0 AND 49 THEN p_size + 2000 WHEN p_size BETWEEN 50 AND 99 THEN p_size + 1900 ELSE p_size END AS INTEGER) AS year FROM part")
def clean_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "part").select(F.concat(F.lit(" "), F.upper("p_brand"), F.lit("\t")).alias("brand"), F.col("p_type").alias("type"), F.col("p_size").cast("string").alias("year"))
    return years.clean_master(raw, ["brand", "type"], ["year"])


@query("SELECT p_partkey, translate(trim(lower(p_brand || ' ' || p_name)), '015', 'ois') AS normalized FROM part")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", years.normalized_text(F.concat_ws(" ", "p_brand", "p_name")).alias("normalized"))


PLATES = "upper(substr(c_mktsegment, 1, c_custkey % 4)) || CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE '' END || (c_custkey % 13000) || CASE WHEN c_custkey % 7 = 0 THEN 'A' ELSE '' END"


@query(rf"SELECT c_custkey, regexp_matches(p, '^[A-Z]{{2,3}}\s?\d{{3,4}}$') AS strict, regexp_matches(p, '^[A-Z]{{1,3}}\s?\d{{1,4}}\s?[A-Z]?$') OR regexp_matches(p, '^W[A-Z]{{2}}\s?\d{{1,4}}$') AS wide FROM (SELECT c_custkey, {PLATES} AS p FROM customer)")
def plate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    plate = F.expr(PLATES)
    return table(spark, sf_dir, "customer").select("c_custkey", rules.plate_strict(plate).alias("strict"), rules.plate_wide(plate).alias("wide"))


PHONES = "CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN '01' || (c_custkey % 10) || '-' || (1000000 + c_custkey) WHEN 2 THEN '+601' || (c_custkey % 10) || (10000000 + c_custkey) ELSE '09' || c_custkey END"


@query(rf"SELECT c_custkey, p = '' OR regexp_matches(p, '^(\+?6?01)[0-46-9]-*[0-9]{{7,8}}$') AS ok FROM (SELECT c_custkey, {PHONES} AS p FROM customer)")
def phone_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", rules.phone(F.expr(PHONES)).alias("ok"))


@query("""SELECT c_custkey, concat_ws(',', CASE WHEN NOT regexp_matches(e, '^[^@\\s]+@[^@\\s]+\\.[^@\\s.]+$') THEN 'email' END, CASE WHEN length(pw) NOT BETWEEN 6 AND 100 THEN 'password' END, CASE WHEN length(fn) NOT BETWEEN 2 AND 50 THEN 'first_name' END,
    CASE WHEN length(ln) NOT BETWEEN 2 AND 50 THEN 'last_name' END, CASE WHEN pw <> cf THEN 'confirm' END) AS violations
    FROM (SELECT c_custkey, c_name || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '@x.org' END AS e, repeat('p', CAST(c_custkey % 9 AS INTEGER)) AS pw, substr(c_name, 1, CAST(c_custkey % 5 AS INTEGER)) AS fn, c_mktsegment AS ln, repeat('p', CAST(c_custkey % 8 AS INTEGER)) AS cf FROM customer)""")
def account_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "c_name || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '@x.org' END AS e", "repeat('p', cast(c_custkey % 9 as int)) AS pw", "substr(c_name, 1, cast(c_custkey % 5 as int)) AS fn", "c_mktsegment AS ln", "repeat('p', cast(c_custkey % 8 as int)) AS cf"
    )
    c = F.col
    return own.select("c_custkey", F.array_join(rules.violations(rules.account_rules(c("e"), c("pw"), c("fn"), c("ln"), c("cf"))), ",").alias("violations"))


@query("""SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 5 = 0 THEN 'plate' END, CASE WHEN NOT (1900 + p_size * 3 BETWEEN 1900 AND 2026) THEN 'year' END, CASE WHEN p_partkey % 4 <> 0 THEN 'vin' END, CASE WHEN NOT (p_size * 3 BETWEEN 0 AND 100) THEN 'score' END) AS violations FROM part""")
def vehicle_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    plate = F.when(F.col("p_partkey") % 5 == 0, " ").otherwise("AB 1")
    vin = F.when(F.col("p_partkey") % 4 != 0, "SHORT")
    found = rules.vehicle_rules(plate, F.col("p_brand"), F.col("p_name"), 1900 + F.col("p_size") * 3, vin, F.col("p_size") * 3, 2025)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(rules.violations(found), ",").alias("violations"))


@query("SELECT doc_id, concat_ws(',', CASE WHEN source NOT IN ('src1', 'src2', 'src3') THEN 'type' END, CASE WHEN n_chars > 5000 THEN 'size' END) AS violations FROM documents")
def document_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.document_rules(F.col("source"), F.col("lang"), F.col("n_chars"), ["src1", "src2", "src3"], 5000)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(rules.violations(found), ",").alias("violations"))


@query("SELECT o_orderkey, concat_ws(',', CASE WHEN NOT (o_totalprice - 150000 > 0) THEN 'amount' END, CASE WHEN o_custkey % 10 = 0 THEN 'vehicle' END) AS violations, CASE WHEN o_orderkey % 3 = 0 THEN 'Expense' ELSE o_orderpriority END AS title FROM orders")
def expense_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner = F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey"))
    title = F.when(F.col("o_orderkey") % 3 == 0, F.lit(" ")).otherwise(F.col("o_orderpriority"))
    found = rules.expense_rules((F.col("o_totalprice") - 150000).cast("string"), owner)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(rules.violations(found), ",").alias("violations"), F.coalesce(rules.blank_to_null(title), F.lit("Expense")).alias("title"))


CHECKED = """(SELECT p_partkey, COALESCE(contains(lower(om), lower(p_brand)), true) AS make, COALESCE(abs(p_size - oy) <= 1, true) AS year, CASE WHEN (om IS NOT NULL OR oy IS NOT NULL) AND pl IS NOT NULL THEN regexp_matches(upper(pl), '^[A-Z]{1,3}\\s?\\d{1,4}\\s?[A-Z]?$') ELSE true END AS plate FROM
    (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN 'THE ' || p_brand ELSE 'other' END AS om, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size + p_partkey % 4 END AS oy, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 = 1 THEN 'ABC 12' ELSE '12 ABC' END AS pl FROM part))"""


@query(f"SELECT p_partkey, make, year, plate, ROUND((CAST(make AS INTEGER) + CAST(year AS INTEGER) + CAST(plate AS INTEGER)) * 100 / 3.0, 4) AS score, CAST(floor(0.6 * (p_partkey % 101) + 0.3 * ((CAST(make AS INTEGER) + CAST(year AS INTEGER) + CAST(plate AS INTEGER)) * 100 / CAST(3 AS DOUBLE)) + 0.1 * 50 + 0.5) AS BIGINT) AS overall FROM {CHECKED}")
def cross_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    ocr_make = F.when(key % 3 == 1, F.concat(F.lit("THE "), "p_brand")).when(key % 3 == 2, "other")
    ocr_year = F.when(key % 4 != 0, F.col("p_size") + key % 4)
    plate = F.when(key % 5 == 1, "ABC 12").when(key % 5 != 0, "12 ABC")
    checks = rules.cross_checks(F.col("p_brand"), ocr_make, F.col("p_size"), ocr_year, plate)
    own = table(spark, sf_dir, "part").select("p_partkey", *[v.alias(k) for k, v in checks.items()])
    score = rules.checks_score({k: F.col(k) for k in checks})
    return own.select("p_partkey", *checks, F.round(score, 4).alias("score"), rules.overall_score((key % 101).cast("double"), score, F.lit(50.0)).alias("overall"))


@query("""SELECT p_partkey, 'brand' AS field, lower(p_brand) AS suggestion, CASE WHEN p_size < 50 THEN 'high' ELSE 'medium' END AS priority FROM part WHERE p_partkey % 2 = 0
    UNION ALL SELECT p_partkey, 'name', p_name, CASE WHEN p_size * 2 < 50 THEN 'high' ELSE 'medium' END FROM part WHERE p_partkey % 3 = 0 AND p_size > 10""")
def recommendation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [("brand", F.col("p_partkey") % 2 != 0, F.lower("p_brand"), F.col("p_size")), ("name", F.col("p_partkey") % 3 != 0, F.when(F.col("p_size") > 10, F.col("p_name")), F.col("p_size") * 2)]
    return rules.recommendations(table(spark, sf_dir, "part"), "p_partkey", fields)


@query("""SELECT p_partkey, CAST(trunc(TRY_CAST(y AS DOUBLE)) AS INTEGER) AS year, TRY_CAST(CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE '2001-0' || (1 + p_partkey % 9) || '-15' END AS DATE) AS expiry, nullif(trim(t), '') AS color
    FROM (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'x' ELSE (1990 + p_size) || '.7' END AS y, CASE WHEN p_partkey % 5 = 0 THEN '  ' ELSE ' ' || p_type || ' ' END AS t FROM part)""")
def coerce_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    iso = F.concat(F.lit("2001-0"), (1 + key % 9).cast("string"), F.lit("-15"))
    dotted = F.concat(F.lit("15.0"), (1 + key % 9).cast("string"), F.lit(".2001"))
    patch = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(key % 4 == 0, "x").otherwise(F.concat((1990 + F.col("p_size")).cast("string"), F.lit(".7"))).alias("year"),
        F.when(key % 3 == 0, iso).when(key % 3 == 1, dotted).otherwise("soon").alias("expiry"), F.when(key % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_type", F.lit(" "))).alias("color"), F.lit("dropped").alias("unknown"),
    )
    return rules.coerced(patch, ["p_partkey", "year"], ["expiry"], ["color"]).select(F.col("p_partkey").cast("bigint").alias("p_partkey"), "year", F.to_date("expiry").alias("expiry"), "color")


@query("""SELECT doc_id, CASE WHEN length(text) > 120 THEN substr(text, 1, 120) || '...' ELSE text END AS summary,
    CASE WHEN n_chars >= 1000 THEN ((n_chars + 50) // 1000) || '.' || ((n_chars + 50) // 100 % 10) || ' KB' ELSE n_chars || ' B' END AS size FROM documents""")
def summary_and_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", shortened(F.col("text")).alias("summary"), size_label(F.col("n_chars")).alias("size"))


@query("""SELECT o_orderkey, CASE WHEN v < 0 THEN '-' ELSE '' END || 'RM\u00a0' || format('{:,.2f}', abs(v)) AS amount, format('{:,}', CAST(o_custkey * 37 AS BIGINT)) || ' km' AS distance, TRY_CAST(regexp_extract(text, '^\\s*([+-]?[0-9]+\\.?[0-9]*)', 1) AS DOUBLE) AS number,
    CAST((o_custkey * 37) % 100000 AS DOUBLE) / 1000 AS progress, lpad(CAST(o_custkey % 1000 AS VARCHAR), 6, '0') AS padded, base64(encode(o_clerk)) AS coded, url_encode(text) AS uri, strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00.000Z' AS midnight
    FROM (SELECT *, CAST(o_totalprice AS DOUBLE) * CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE 1 END AS v, CASE o_orderkey % 3 WHEN 0 THEN ' 12.5 km' WHEN 1 THEN '-7' ELSE 'none & all' END AS text FROM (SELECT *, o_orderpriority AS o_clerk FROM orders))""".replace("\\u00a0", "\u00a0"))
def display_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How amounts, distances, texts and days are shown."""
    key, far = F.col("o_orderkey"), F.col("o_custkey") * 37
    text = F.when(key % 3 == 0, " 12.5 km").when(key % 3 == 1, "-7").otherwise("none & all")
    amount = F.col("o_totalprice").cast("double") * F.when(key % 5 == 0, -1).otherwise(1)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", currency(amount).alias("amount"), kilometres(far).alias("distance"), number_prefix(text).alias("number"), progress(far, 100_000).alias("progress"),
        F.lpad((F.col("o_custkey") % 1000).cast("string"), 6, "0").alias("padded"), F.base64(F.col("o_orderpriority").cast("binary")).alias("coded"), uri_part(text).alias("uri"), midnight_text("o_orderdate").alias("midnight"),
    )


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(substr(x, 1, 1)) || lower(substr(x, 2))), ' ') AS title FROM part")
def title_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.initcap("p_name").alias("title"))


@query("""SELECT o_orderkey, c ->> '$.kind' AS kind, CAST(c ->> '$.amount' AS DOUBLE) AS amount, CAST(c ->> '$.paid' AS BOOLEAN) AS paid
    FROM (SELECT o_orderkey, CAST('{"kind": "' || o_orderpriority || '", "amount": ' || o_custkey || '.5, "paid": ' || CASE WHEN o_custkey % 2 = 0 THEN 'true' ELSE 'false' END || '}' AS JSON) AS c FROM orders)""")
def payload_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON payload parsed into typed columns, once a row."""
    text = F.concat(F.lit('{"kind": "'), "o_orderpriority", F.lit('", "amount": '), F.col("o_custkey").cast("string"), F.lit('.5, "paid": '), F.when(F.col("o_custkey") % 2 == 0, "true").otherwise("false"), F.lit("}"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.from_json(text, "kind string, amount double, paid boolean").alias("c")).select("o_orderkey", "c.*")
