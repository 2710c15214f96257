"""Queries on record access, search, reports, synthetic data and learned correctors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendwright.functions.expr import char_ngrams
from mendwright.functions.numbering import numbered
from mendwright.functions.storage import shared_folder
from mendwright.operators import expiry, learned, nearest, records, reports, synthetic
from mendwright.operators.stored import StoredTable
from mendwright.plans.base import query, table

WHO = 7


@query(f"SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_custkey = {WHO}")
def owner_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.owned_latest_first(table(spark, sf_dir, "orders"), "o_custkey", WHO, ["o_orderdate"], "o_orderkey").select("o_orderkey", "o_orderdate", "o_totalprice")


@query(f"SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = {WHO} AND o_orderkey = (SELECT MIN(o_orderkey) FROM orders WHERE o_custkey = {WHO})")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    key = orders.where(F.col("o_custkey") == WHO).agg(F.min("o_orderkey")).scalar()
    return records.lookup(orders, "o_custkey", WHO, "o_orderkey", key).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'DONE' ELSE o_orderstatus END AS o_orderstatus FROM orders UNION ALL SELECT -o_orderkey, 'NEW' FROM orders WHERE o_orderkey % 100 = 0 AND o_orderkey > 0")
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    changed = orders.where("o_orderkey % 10 = 0").select("o_orderkey", F.lit("DONE").alias("o_orderstatus"))
    new = orders.where("o_orderkey % 100 = 0 and o_orderkey > 0").select((-F.col("o_orderkey")).alias("o_orderkey"), F.lit("NEW").alias("o_orderstatus"))
    return records.upserted(orders, changed.unionByName(new), "o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def delete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return records.without(table(spark, sf_dir, "orders").select("o_orderkey"), gone, "o_orderkey")


@query(f"""SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 = 0 THEN 'DONE' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE NOT (o_orderkey % 3 = 0 AND o_custkey = {WHO})
    UNION ALL SELECT -o_orderkey, o_custkey, 'NEW' FROM orders WHERE o_orderkey % 100 = 0 AND o_orderkey > 0""")
def stored_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders stored, then updated, added to, and an owner's own deleted, each as a version; what is read is the last one."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    stored = StoredTable.create(orders, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}", "o_orderkey", "o_custkey", buckets=16)
    stored.update(orders.where("o_orderkey % 10 = 0"), {"o_orderstatus": "DONE"})
    stored.upsert(orders.where("o_orderkey % 100 = 0 and o_orderkey > 0").select((-F.col("o_orderkey")).alias("o_orderkey"), "o_custkey", F.lit("NEW").alias("o_orderstatus")))
    stored.delete(orders.where("o_orderkey % 3 = 0"), who=WHO)
    return stored.read()


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def owners_with_large_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(large, "c_custkey", "left_semi")


@query("SELECT c_custkey, n.orders, n.latest FROM customer LEFT JOIN (SELECT o_custkey, COUNT(*) AS orders, MAX(o_orderdate) AS latest FROM orders GROUP BY 1) n ON o_custkey = c_custkey")
def owner_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.with_children(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey", [F.count("*").alias("orders"), F.max("o_orderdate").alias("latest")])


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, COALESCE(o_orderpriority, '') AS kind, strftime(o_orderdate, '%Y-%m-%d') AS day, COALESCE(CAST(o_custkey AS VARCHAR), '') AS owner FROM orders")
def autofill_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.autofill(table(spark, sf_dir, "orders"), {"id": "o_orderkey", "kind": "o_orderpriority", "day": "o_orderdate", "owner": "o_custkey"})


@query("SELECT p_partkey, p_brand FROM part")
def allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.allowed(table(spark, sf_dir, "part"), ["p_partkey", "unknown", "p_brand"])


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'ABC 1' WHEN p_partkey % 3 = 1 THEN p_brand || ' ' || p_name ELSE substr(CAST(p_partkey AS VARCHAR), 1, 6) END AS label,
    p_brand || ' ' || p_name || CASE WHEN p_size > 20 THEN ' (' || p_size || ')' ELSE '' END AS title FROM part""")
def vehicle_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_partkey") % 3
    plate = F.when(kind == 0, " ABC 1 ").otherwise(" ")
    brand, model = F.when(kind == 1, F.col("p_brand")), F.when(kind == 1, F.col("p_name"))
    suffix = F.when(F.col("p_size") > 20, F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", records.label(plate, brand, model, F.col("p_partkey")).alias("label"), records.titled(F.col("p_brand"), F.col("p_name"), suffix).alias("title"))


@query("SELECT doc_id, source, n_chars FROM documents WHERE source = 'src3' AND contains(lower(concat_ws(' ', source, lang, text)), 'the')")
def doc_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = records.filtered(table(spark, sf_dir, "documents"), {"source": "src3", "lang": "All"})
    return own.where(records.matching_text(["source", "lang", "text"], " THE ")).orderBy(F.desc("doc_id")).select("doc_id", "source", "n_chars")


@query("SELECT p_partkey FROM part WHERE contains(lower(concat_ws(' ', p_brand, p_name, p_size)), 'gear 1')")
def vehicle_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(records.matching_text(["p_brand", "p_name", "p_size"], "Gear 1")).select("p_partkey")


AS_OF = "2001-10-15 12:00:00"
DIFF = f"date_diff('day', DATE '{AS_OF[:10]}', CAST(l_shipdate AS DATE))"


@query(f"SELECT COUNT(*) AS total, CAST(count_if({DIFF} > 30) AS BIGINT) AS valid, CAST(count_if({DIFF} BETWEEN 0 AND 30) AS BIGINT) AS expiring, CAST(count_if({DIFF} < 0) AS BIGINT) AS expired FROM lineitem")
def doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expiry.class_counts(table(spark, sf_dir, "lineitem"), expiry.calendar_class(F.col("l_shipdate"), F.lit(AS_OF).cast("timestamp_ntz")))


# Fields by the words that name them, in order.
FIELDS = [("plate", ["plate", "registration"]), ("make", ["brand", "onwh"]), ("model", ["model", "reth"]), ("year", ["year", "the"])]
FIELD_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + f" THEN '{f}'" for f, ws in FIELDS) + " END"


@query(f"SELECT doc_id, {FIELD_SQL} AS field FROM documents")
def keyword_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.first_keyword(table(spark, sf_dir, "documents"), "doc_id", "text", FIELDS)


@query("SELECT event_type, COUNT(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1")
def level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.value_counts(table(spark, sf_dir, "events"), "event_type")


@query("SELECT event_id, CAST(json_valid(props) AS BOOLEAN) AS ok, CAST(len(json_keys(props)) AS INTEGER) AS keys FROM events")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.json_object_keys("props")
    return table(spark, sf_dir, "events").select("event_id", keys.isNotNull().alias("ok"), F.size(keys).alias("keys"))


@query("SELECT COUNT(DISTINCT p_brand) AS brands, COUNT(DISTINCT p_name) AS names, MIN(p_size) AS low, MAX(p_size) AS high FROM part")
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").agg(F.countDistinct("p_brand").alias("brands"), F.countDistinct("p_name").alias("names"), F.min("p_size").alias("low"), F.max("p_size").alias("high"))


@query("SELECT DISTINCT p_brand, p_type FROM part")
def distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_brand", "p_type").dropDuplicates()


@query("SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 9 <> 0)")
def fk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = table(spark, sf_dir, "orders").where("o_orderkey % 9 <> 0")
    return records.orphans(table(spark, sf_dir, "lineitem").select("l_orderkey"), "l_orderkey", parents, "o_orderkey").distinct()


@query("""SELECT (SELECT COUNT(*) FROM orders WHERE o_custkey % 50 <> 0) AS cascade_left, (SELECT COUNT(*) FROM orders WHERE o_custkey % 50 = 0) AS nulled, (SELECT COUNT(*) FROM customer WHERE c_custkey % 50 = 0 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS restricted""")
def delete_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleting every fiftieth customer: what cascades, what is set to null, what restricts."""
    gone = table(spark, sf_dir, "customer").where("c_custkey % 50 = 0").select("c_custkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    left = records.without(orders.withColumnRenamed("o_custkey", "c_custkey"), gone, "c_custkey").agg(F.count("*").alias("cascade_left"), F.lit(1).alias("one"))
    nulled = records.set_null(orders, gone, "o_custkey", "c_custkey").agg(F.count_if(F.col("o_custkey").isNull()).alias("nulled"), F.lit(1).alias("one"))
    kept = records.restricting(orders, gone, "o_custkey", "c_custkey").agg(F.count("*").alias("restricted"), F.lit(1).alias("one"))
    return left.join(nulled, "one").join(kept, "one").drop("one")


@query("""WITH r AS (SELECT MIN(value) AS lo, (MAX(value) - MIN(value)) / 10 AS w FROM events) SELECT bin, ROUND(lo + (bin - 1) * w, 6) AS low, COUNT(*) AS n FROM (SELECT CAST(least(floor((value - lo) / w) + 1, 10) AS INTEGER) AS bin, lo, w FROM events, r WHERE value IS NOT NULL) GROUP BY ALL""")
def confidence_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.histogram(table(spark, sf_dir, "events"), "value").withColumn("low", F.round("low", 6))


PREDICTION = "CASE WHEN p_partkey % 6 = 0 THEN 'other' ELSE p_type END"


@query(f"SELECT p_type AS actual, {PREDICTION} AS predicted, COUNT(*) AS n FROM part GROUP BY 1, 2")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.confusion(table(spark, sf_dir, "part").withColumn("predicted", F.expr(PREDICTION)), "p_type", "predicted")


STATUS = "CASE event_id % 10 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'ERROR' ELSE 'PASSED' END"


@query(f"""SELECT event_type, COUNT(*) AS total, CAST(count_if(s = 'PASSED') AS BIGINT) AS passed, CAST(count_if(s = 'FAILED') AS BIGINT) AS failed, CAST(count_if(s = 'ERROR') AS BIGINT) AS errors, ROUND(100 * AVG(CAST(s = 'PASSED' AS DOUBLE)), 4) AS rate,
    MIN(value) AS fastest, MAX(value) AS slowest, ROUND(AVG(value), 6) AS mean FROM (SELECT *, {STATUS} AS s FROM events) GROUP BY 1""")
def test_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.status_breakdown(table(spark, sf_dir, "events").withColumn("status", F.expr(STATUS)), "event_type", "status", "value")


@query("""SELECT vec_id, target, ROUND(s, 5) AS similarity FROM (SELECT a.vec_id, b.vec_id AS target, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
    WHERE s >= 0.2 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY ROUND(s, 9) DESC, target) = 1""")
def embedding_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stated set of queries, the ids divisible by 20, against all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest.nearest(vectors.where("vec_id % 20 = 0"), vectors, 0.2)


def _pick(salt: str, n: str) -> str:
    return f"CAST(CAST('0x' || substr(md5(p_partkey || '|{salt}'), 1, 8) AS BIGINT) % {n} AS INTEGER)"


AT, TWO, LETTER, GAP = _pick("typo-at", "greatest(length(p_name), 1)"), _pick("typo-two", "greatest(length(p_name) - 1, 1)"), _pick("typo-letter", "26"), _pick("typo-gap", "(length(p_name) + 1)")
KIND = "['substitute', 'delete', 'insert', 'transpose', 'misread', 'neighbour'][p_partkey % 6 + 1]"
BESIDE = "MAP {'q': 'wa', 'w': 'qes', 'e': 'wrd', 'r': 'etf', 't': 'ryg', 'y': 'tuh', 'u': 'yij', 'i': 'uok', 'o': 'ipl', 'p': 'ol', 'a': 'qsz', 's': 'adwx', 'd': 'sfec', 'f': 'dgrv', 'g': 'fhtb', 'h': 'gjyn', 'j': 'hkum', 'k': 'jli', 'l': 'kop', 'z': 'ax', 'x': 'zcs', 'c': 'xvd', 'v': 'cbf', 'b': 'vng', 'n': 'bmh', 'm': 'nj'}"


@query(f"""SELECT p_partkey, kind, CASE WHEN length(p_name) < 2 THEN p_name ELSE CASE kind WHEN 'substitute' THEN h || l || t WHEN 'delete' THEN h || t WHEN 'insert' THEN substr(low, 1, gap - 1) || l || substr(low, gap) WHEN 'transpose' THEN substr(low, 1, two - 1) || substr(low, two + 1, 1) || substr(low, two, 1) || substr(low, two + 2)
    WHEN 'misread' THEN h || translate(c, 'o0i1ls5b6g', '0o1i15s6b9') || t ELSE h || COALESCE(substr(near, CAST({_pick('typo-near', 'greatest(length(near), 1)')} + 1 AS BIGINT), 1), c) || t END END AS typo FROM (SELECT *, {BESIDE}[c] AS near FROM
    (SELECT p_partkey, p_name, low, kind, two, gap, substr(low, 1, a - 1) AS h, substr(low, a, 1) AS c, substr(low, a + 1) AS t, substr('abcdefghijklmnopqrstuvwxyz', l, 1) AS l FROM
    (SELECT p_partkey, p_name, lower(p_name) AS low, {KIND} AS kind, {AT} + 1 AS a, {TWO} + 1 AS two, {LETTER} + 1 AS l, {GAP} + 1 AS gap FROM part)))""")
def typo_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(k) for k in synthetic.KINDS]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"), synthetic.faulty(F.col("p_name"), F.col("p_partkey"), kind).alias("typo"))


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    each = {"brand": F.lower("p_brand"), "model": F.lower("p_name"), "combined": F.lower(F.concat_ws(" ", "p_brand", "p_name"))}
    own = part.select(F.inline(F.array(*[F.struct(F.lit(k).alias("field_type"), v.alias("value")) for k, v in each.items()]))).distinct()
    return own.transform(numbered, ["value"], by="field_type")


def _dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.dataset(_values(spark, sf_dir), 6000)


@query()
def synthetic_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dataset(spark, sf_dir)


@query("SELECT label, MAX(position) - 1 AS index FROM (SELECT label, row_number() OVER (ORDER BY k, label) AS position FROM (SELECT DISTINCT 0 AS k, lower(p_brand) AS label FROM part UNION ALL SELECT DISTINCT 1, lower(p_name) FROM part)) GROUP BY 1")
def label_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    brands, names = part.select(F.lit(0).alias("k"), F.lower("p_brand").alias("label")).distinct(), part.select(F.lit(1).alias("k"), F.lower("p_name").alias("label")).distinct()
    return synthetic.label_index(numbered(brands.unionByName(names), ["k", "label"]))


@query("""SELECT p_partkey, CASE WHEN row_number() OVER (PARTITION BY p_type ORDER BY md5(p_partkey || '42'), p_partkey) <= ceil(COUNT(*) OVER (PARTITION BY p_type) * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS part FROM part""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.split(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_partkey", "p_type").select("p_partkey", "part")


@query("SELECT gram, COUNT(*) AS n FROM (SELECT substr(p_name, CAST(i AS INTEGER), CAST(k AS INTEGER)) AS gram FROM part, range(2, 5) a(k), range(1, 40) b(i) WHERE i + k - 1 <= length(p_name)) GROUP BY 1")
def ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.explode(char_ngrams(F.col("p_name"), 2, 4)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


def _evaluated(spark: SparkSession, sf_dir: str, kind: str, n: int = 6000) -> DataFrame:
    own = synthetic.split(synthetic.dataset(_values(spark, sf_dir).where("field_type <> 'combined'"), n * 2 // 3), "row_id", "correct_text")
    model = learned.fit(own.where("part = 'train'").drop("part"), kind, 1000)
    return learned.predict(model, own.where("part = 'test'").drop("part"), 0.05, kind)


@query()
def nb_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir, "naive_bayes")


@query()
def logistic_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir, "logistic")


@query()
def rf_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir, "random_forest")


@query()
def svm_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir, "svm")


@query()
def boosting_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir, "gradient_boosting")


@query()
def nb_cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of accuracy over five folds."""
    mean, deviation = learned.cross_validated(synthetic.dataset(_values(spark, sf_dir).where("field_type = 'brand'"), 1500), "naive_bayes")
    return spark.createDataFrame([("naive_bayes", 5, float(mean), float(deviation))], "kind string, folds int, mean double, deviation double")


@query("SELECT event_type, COUNT(*) AS n, ROUND(COUNT(*) / SUM(value), 6) AS per_second, ROUND(1000 * AVG(value), 4) AS latency_ms FROM events GROUP BY 1")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.throughput(table(spark, sf_dir, "events"), "event_type", "value")
