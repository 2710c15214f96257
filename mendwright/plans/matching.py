"""Queries on matching, cascades, votes and evaluation, bound to part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mendwright.functions.expr import char_ngrams, once
from mendwright.functions.storage import kept
from mendwright.operators import bayes, cascade, harness, learned, nearest, similarity, synthetic
from mendwright.plans.base import query, table

# names with planted faults, by key: none, a letter lost, two swapped, a misread and an added letter
FAULTY = "CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN substr(p_name, 1, 2) || substr(p_name, 4) WHEN 2 THEN substr(p_name, 1, 1) || substr(p_name, 3, 1) || substr(p_name, 2, 1) || substr(p_name, 4) ELSE translate(p_name, 'o', '0') || 'x' END"
INPUTS = f"(SELECT DISTINCT {FAULTY} AS input FROM part)"
NAMES = "(SELECT candidate, row_number() OVER (ORDER BY candidate) AS position FROM (SELECT DISTINCT p_name AS candidate FROM part))"
BOUND = "2 * least(length(input), length(candidate)) >= {} * (length(input) + length(candidate))"


def _inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.expr(FAULTY).alias("input")).distinct()


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("candidate")).distinct()
    return names.withColumn("position", F.col("candidate"))


LEV = f"""SELECT input, arg_min(candidate, position) AS candidate, arg_min(c, position) AS confidence FROM (SELECT *, 1 - levenshtein(input, candidate) / CAST(greatest(length(input), length(candidate)) AS DOUBLE) AS c
    FROM {INPUTS}, {NAMES} WHERE length(input) > 2 AND length(candidate) > 2 AND levenshtein(input, candidate) <= 0.3 * greatest(length(input), length(candidate))) WHERE c >= 0.7 GROUP BY 1"""


@query(LEV)
def match_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.first_levenshtein(_inputs(spark, sf_dir), _names(spark, sf_dir))


@query(f"""SELECT input, candidate, confidence, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY input ORDER BY confidence DESC, candidate DESC) AS k FROM
    (SELECT input, candidate, 1 - levenshtein(input, candidate) / CAST(greatest(length(input), length(candidate), 1) AS DOUBLE) AS confidence FROM {INPUTS}, {NAMES} WHERE {BOUND.format(0.6)}) WHERE confidence >= 0.6) WHERE k <= 3""")
def top3_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.suggestions(_inputs(spark, sf_dir), _names(spark, sf_dir), score=similarity.levenshtein_score, reverse=False)


@query()
def suggest_gestalt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.suggestions(_inputs(spark, sf_dir), _names(spark, sf_dir))


@query(f"SELECT input, arg_min(candidate, struct_pack(s := -s, c := candidate)) AS candidate, -MIN(-s) AS similarity FROM (SELECT input, candidate, ROUND(jaro_winkler_similarity(input, candidate), 9) AS s FROM {INPUTS}, {NAMES} WHERE 2 * least(length(input), length(candidate)) >= 0.8 * (length(input) + length(candidate))) WHERE s >= 0.9 GROUP BY input")
def match_jaro_winkler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar name of about the same length by Jaro-Winkler, from 0.9 on."""
    return similarity.closest_name(_inputs(spark, sf_dir), _names(spark, sf_dir), 0.9, 0.8)


@query()
def suggest_years_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = table(spark, sf_dir, "part").select((1980 + F.col("p_size")).cast("string").alias("candidate")).distinct().withColumn("position", F.lit(0))
    inputs = table(spark, sf_dir, "part").select((1970 + F.col("p_size")).cast("string").alias("input")).distinct()
    return similarity.suggestions(inputs, years, n=5, cutoff=0.6)


USERS = f"(SELECT p_partkey AS key, ' ' || upper(p_brand) AS brand, {FAULTY} AS model, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE CAST(1985 + p_size AS VARCHAR) END AS year, CASE WHEN p_partkey % 5 = 0 THEN 'W 1' ELSE 'WXY 1234' END AS plate FROM part)"
MASTER = "(SELECT lower(p_brand) AS brand, lower(p_name) AS model, CAST(1990 + MIN(p_size) % 10 AS INTEGER) AS year_start, CAST(2015 + MAX(p_size) % 10 AS INTEGER) AS year_end, row_number() OVER (ORDER BY lower(p_brand), lower(p_name)) AS position FROM part GROUP BY 1, 2)"


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    return part.select(key.alias("key"), F.concat(F.lit(" "), F.upper("p_brand")).alias("brand"), F.expr(FAULTY).alias("model"), F.when(key % 6 != 0, (1985 + F.col("p_size")).cast("string")).alias("year"), F.when(key % 5 == 0, "W 1").otherwise("WXY 1234").alias("plate"))


def _master(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").groupBy(F.lower("p_brand").alias("brand"), F.lower("p_name").alias("model")).agg((1990 + F.min("p_size") % 10).alias("year_start"), (2015 + F.max("p_size") % 10).alias("year_end"))
    return rows.withColumn("position", F.struct("brand", "model"))


MATCHED = f"""(WITH u AS (SELECT *, translate(lower(trim(brand)), '015', 'ois') AS nb, translate(lower(trim(model)), '015', 'ois') AS nm, CASE WHEN CAST(year AS INTEGER) BETWEEN 1900 AND 2030 THEN CAST(year AS INTEGER) END AS ny FROM {USERS}), m AS (SELECT * FROM {MASTER}),
    sb AS (SELECT nb, cb, 1 - levenshtein(nb, cb) / CAST(greatest(length(nb), length(cb), 1) AS DOUBLE) AS sb FROM (SELECT DISTINCT nb FROM u), (SELECT DISTINCT brand AS cb FROM m)),
    sm AS (SELECT nm, cm, 1 - levenshtein(nm, cm) / CAST(greatest(length(nm), length(cm), 1) AS DOUBLE) AS sm FROM (SELECT DISTINCT nm FROM u), (SELECT DISTINCT model AS cm FROM m)),
    b AS (SELECT u.key AS k, m.brand AS mb, m.model AS mm, year_start, year_end, position, sb, sm, CAST(0.4 AS DOUBLE) * sb + CAST(0.4 AS DOUBLE) * sm + CASE WHEN ny BETWEEN year_start AND year_end THEN CAST(0.2 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS score FROM u JOIN sb USING (nb) JOIN m ON m.brand = cb JOIN sm ON sm.nm = u.nm AND sm.cm = m.model),
    w AS (SELECT * FROM b WHERE score >= CAST(0.8 AS DOUBLE) QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, position) = 1),
    q AS (SELECT *, concat_ws(', ', CASE WHEN plate = 'W 1' THEN 'plate_format_error' END, CASE WHEN nb <> mb THEN CASE WHEN sb > 0.6 THEN 'typo_brand' ELSE 'wrong_brand' END END,
    CASE WHEN nm <> mm THEN CASE WHEN sm > 0.6 THEN 'typo_model' ELSE 'wrong_model' END END, CASE WHEN k IS NOT NULL AND ny NOT BETWEEN year_start AND year_end THEN 'invalid_year' END,
    CASE WHEN k IS NOT NULL AND ny IS NULL THEN 'missing_year' END, CASE WHEN k IS NULL THEN 'no_match_found' END) AS e FROM u LEFT JOIN w ON k = key)
    SELECT plate AS user_input_plate, brand AS user_input_brand, model AS user_input_model, COALESCE(year, '') AS user_input_year, nb AS normalized_brand, nm AS normalized_model, ny AS normalized_year, COALESCE(CAST(year_start AS VARCHAR), '') AS matched_year_start, COALESCE(CAST(year_end AS VARCHAR), '') AS matched_year_end,
    key, mb AS matched_brand, mm AS matched_model, COALESCE(score, 0.0) AS confidence_score, CASE WHEN e = '' THEN 'correct' ELSE e END AS error_types, e <> '' AS has_errors FROM q)"""


def _classified(spark: SparkSession, sf_dir: str, score) -> DataFrame:
    found = similarity.best_matches(_users(spark, sf_dir), _master(spark, sf_dir), score)
    return similarity.error_types(found, F.col("plate")).select("key", F.col("match.mb").alias("matched_brand"), F.col("match.mm").alias("matched_model"), "confidence_score", "error_types", "has_errors")


@query(f"SELECT key, matched_brand, matched_model, ROUND(confidence_score, 6) AS confidence_score, error_types, has_errors FROM {MATCHED}")
def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, similarity.levenshtein_score).withColumn("confidence_score", F.round("confidence_score", 6))


@query(f"SELECT error, COUNT(*) AS n FROM (SELECT unnest(string_split(error_types, ', ')) AS error FROM {MATCHED}) WHERE error <> 'correct' GROUP BY 1")
def error_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.error_distribution(_classified(spark, sf_dir, similarity.levenshtein_score))


@query(f"""SELECT user_input_plate, user_input_brand, user_input_model, user_input_year, normalized_brand, normalized_model, normalized_year, COALESCE(matched_brand, '') AS matched_brand, COALESCE(matched_model, '') AS matched_model,
    matched_year_start, matched_year_end, ROUND(confidence_score, 6) AS confidence_score, error_types, has_errors FROM {MATCHED}""")
def processed_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report on user inputs, all 14 columns."""
    return similarity.processed_inputs(_users(spark, sf_dir), _master(spark, sf_dir), similarity.levenshtein_score).withColumn("confidence_score", F.round("confidence_score", 6))


@query()
def match_gestalt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, similarity.gestalt)


@query()
def comprehensive_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = _users(spark, sf_dir).withColumn("brand", F.lower(F.trim("brand")))
    return similarity.comprehensive(users, _master(spark, sf_dir))


@query()
def integrated_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year validation with its methods, and the best brand and model of each row."""
    users = _users(spark, sf_dir).withColumn("brand", F.lower(F.trim("brand")))
    done = similarity.comprehensive(users, _master(spark, sf_dir))
    of = lambda c, f: F.try_element_at(F.filter("corrections", lambda x: x["field"] == c), F.lit(1))[f]
    return done.select("key", "year", of("year", "confidence").alias("year_confidence"), of("brand", "corrected").alias("brand_suggestion"), of("brand", "confidence").alias("brand_confidence"), of("model", "corrected").alias("model_suggestion"), of("model", "confidence").alias("model_confidence"))


DIRECT = f"(SELECT input, MIN(p_name) AS correction, 1.0 AS confidence FROM (SELECT {FAULTY} AS input, * FROM part) WHERE p_partkey % 3 = 0 AND p_partkey % 4 <> 0 GROUP BY 1)"
FUZZY = f"(SELECT input, MIN(p_name) AS correction, CAST(MIN(p_partkey % 10) AS DOUBLE) / 10 AS confidence FROM (SELECT {FAULTY} AS input, * FROM part) WHERE p_partkey % 3 = 1 AND p_partkey % 4 <> 0 GROUP BY 1)"


@query(f"""WITH i AS (SELECT p_partkey AS key, CASE WHEN p_partkey % 11 = 0 THEN ' ' WHEN p_partkey % 13 = 0 THEN 'zzz999' ELSE {FAULTY} END AS input FROM part), d AS (SELECT * FROM {DIRECT}), f AS (SELECT * FROM {FUZZY}), l AS ({LEV}),
    r AS (SELECT key, i.input, trim(lower(i.input)) AS t, d.correction AS dc, CASE WHEN f.confidence >= 0.7 THEN f.correction END AS fc, f.confidence AS ff, l.candidate AS lc, l.confidence AS lf FROM i LEFT JOIN d ON d.input = trim(lower(i.input)) LEFT JOIN f ON f.input = trim(lower(i.input)) LEFT JOIN l ON l.input = trim(lower(i.input))),
    s AS (SELECT key, input, CASE WHEN t = '' THEN '' ELSE COALESCE(dc, fc, lc, t) END AS corrected, CAST(CASE WHEN t = '' THEN 0 WHEN dc IS NOT NULL THEN 1 WHEN fc IS NOT NULL THEN ff WHEN lc IS NOT NULL THEN lf ELSE 0 END AS DOUBLE) AS confidence,
    CASE WHEN t = '' THEN 'no_input' WHEN dc IS NOT NULL THEN 'direct_mapping' WHEN fc IS NOT NULL THEN 'fuzzy_mapping' WHEN lc IS NOT NULL THEN 'rule_based_levenshtein' ELSE 'no_correction' END AS method FROM r)
    SELECT *, lower(corrected) <> lower(input) AS was_corrected FROM s""")
def cascade_exact_lev(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("input", F.expr(FAULTY))
    key = F.col("p_partkey")
    inputs = part.select(key.alias("key"), F.when(key % 11 == 0, " ").when(key % 13 == 0, "zzz999").otherwise(F.col("input")).alias("input"))
    direct = part.where("p_partkey % 3 = 0 and p_partkey % 4 <> 0").groupBy("input").agg(F.min("p_name").alias("correction"), F.lit(1.0).alias("confidence"))
    fuzzy = part.where("p_partkey % 3 = 1 and p_partkey % 4 <> 0").groupBy("input").agg(F.min("p_name").alias("correction"), (F.min(key % 10).cast("double") / 10).alias("confidence"))
    left = cascade.unresolved(inputs, direct)
    return cascade.correct(inputs, direct, fuzzy, [("rule_based_levenshtein", similarity.first_levenshtein(left, _names(spark, sf_dir)))])


@query()
def cascade_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage of the cascade: mappings, a learned corrector where it is sure, the weighted ratio, edit distance."""
    part = table(spark, sf_dir, "part").withColumn("input", F.expr(FAULTY))
    key = F.col("p_partkey")
    inputs = part.select(key.alias("key"), F.when(key % 11 == 0, " ").when(key % 13 == 0, "zzz999").otherwise(F.col("input")).alias("input"))
    direct = part.where("p_partkey % 3 = 0 and p_partkey % 4 <> 0").groupBy("input").agg(F.min("p_name").alias("correction"), F.lit(1.0).alias("confidence"))
    fuzzy = part.where("p_partkey % 3 = 1 and p_partkey % 4 <> 0").groupBy("input").agg(F.min("p_name").alias("correction"), (F.min(key % 10).cast("double") / 10).alias("confidence"))
    left = cascade.unresolved(inputs, direct)
    brands = part.select(F.lower("p_brand").alias("value")).distinct().withColumn("position", F.row_number().over(Window.orderBy("value"))).withColumn("field_type", F.lit("brand"))  # a few brands
    model = learned.fit(synthetic.dataset(brands, 1500), "naive_bayes", 1000)
    told = learned.predict(model, left.select("input", F.col("input").alias("row_id"), F.col("input").alias("input_text"), F.lit("").alias("correct_text")))
    told = told.where("predicted is not null").select(F.col("input_text").alias("input"), F.col("predicted").alias("candidate"), "confidence")
    names = _names(spark, sf_dir)
    close = similarity.extract_one(left, names).select("input", "candidate", (F.col("score").cast("double") / 100).alias("confidence"))
    return cascade.correct(inputs, direct, fuzzy, cascade.later_stages(told, close, similarity.first_levenshtein(left, names)))


PREDICTED = f"(SELECT p_partkey AS position, {FAULTY} AS input, CASE WHEN p_partkey % 5 = 0 THEN 'wrong' WHEN p_partkey % 7 = 0 THEN NULL ELSE p_name END AS predicted, p_name AS actual, CAST(p_partkey % 10 AS DOUBLE) / 10 AS confidence, p_type FROM part)"


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(key.alias("position"), F.expr(FAULTY).alias("input"), F.when(key % 5 == 0, "wrong").when(key % 7 != 0, F.col("p_name")).alias("predicted"), F.col("p_name").alias("actual"), ((key % 10).cast("double") / 10).alias("confidence"), "p_type")


@query(f"SELECT input, arg_max(predicted, position) AS correction, arg_max(confidence, position) AS confidence, kind FROM (SELECT *, CASE WHEN confidence >= 0.7 THEN 'direct' ELSE 'fuzzy' END AS kind FROM {PREDICTED} WHERE predicted = actual AND confidence >= 0.5) GROUP BY input, kind")
def mapping_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.build_mappings(_predicted(spark, sf_dir))


VOTES = "(SELECT p_partkey AS key, 'rule' AS model, p_name AS candidate, CAST(p_partkey % 10 AS DOUBLE) / 10 AS confidence FROM part UNION ALL SELECT p_partkey, 'ml', CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_name END, CAST(p_partkey % 7 AS DOUBLE) / 7 FROM part UNION ALL SELECT p_partkey, 'transformer', p_brand, CAST(p_partkey % 5 AS DOUBLE) / 5 FROM part)"


@query(f"""WITH s AS (SELECT key, candidate, SUM(CASE model WHEN 'rule' THEN CAST(0.3 AS DOUBLE) WHEN 'ml' THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.2 AS DOUBLE) END * confidence) AS s FROM {VOTES} GROUP BY 1, 2),
    b AS (SELECT key, candidate, ROUND(s, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY key ORDER BY ROUND(s, 9) DESC, candidate) = 1) SELECT key, CASE WHEN score >= 0.6 THEN candidate END AS candidate, score FROM b""")
def ensemble_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three votes a row from one scan, not three."""
    key = F.col("p_partkey")
    v = lambda m, c, x: F.struct(F.lit(m).alias("model"), c.alias("candidate"), x.alias("confidence"))
    votes = F.array(v("rule", F.col("p_name"), (key % 10).cast("double") / 10), v("ml", F.when(key % 3 == 0, F.col("p_brand")).otherwise(F.col("p_name")), (key % 7).cast("double") / 7), v("transformer", F.col("p_brand"), (key % 5).cast("double") / 5))
    return cascade.vote(table(spark, sf_dir, "part").select(key.alias("key"), F.inline(votes)))


def _gram_vector(x: str, dims: int = 64) -> Column:
    """How often the n-grams of a text fall into each of ``dims`` places."""
    places = F.transform(char_ngrams(F.lower(F.col(x)), 2, 3), lambda g: F.pmod(F.xxhash64(g), F.lit(dims)).cast("int"))
    return once(places, lambda p: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: (F.size(p) - F.size(F.array_remove(p, k))).cast("double")))


def _rule(names: DataFrame) -> harness.Corrector:
    return lambda inputs: similarity.extract_one(inputs, names).select("input", "candidate", (F.col("score") / 100.0).alias("confidence"), F.lit("weighted_ratio").alias("method"))


def _embedding(names: DataFrame, threshold: float = 0.7) -> harness.Corrector:
    """The name with the most similar n-gram vector. Vectors are kept: filters on them would else move below the ``distinct`` of the texts, to every row."""
    vectors = lambda df, c, mark: kept(df.select(F.concat(F.lit(mark), F.col(c)).alias("vec_id"), _gram_vector(c).alias("embedding")))
    plain = lambda c: F.substr(F.col(c), F.lit(3))
    return lambda inputs: nearest.nearest(vectors(inputs, "input", "i:"), vectors(names, "candidate", "n:"), threshold).select(plain("vec_id").alias("input"), plain("target").alias("candidate"), F.col("similarity").alias("confidence"), F.lit("gram_vectors").alias("method"))


def _learned(names: DataFrame) -> harness.Corrector:
    """A classifier that has learned every name, and every n-gram, from synthetic faults of all names."""
    values = names.select(F.col("candidate").alias("value"))
    return lambda inputs: bayes.predict(bayes.fit(synthetic.faults_of_each(values)), inputs).select("input", F.col("label").alias("candidate"), "confidence", F.lit("naive_bayes").alias("method"))


def _correctors(spark: SparkSession, sf_dir: str) -> dict[str, harness.Corrector]:
    names = _names(spark, sf_dir)
    return {"rule": _rule(names), "ml": _learned(names), "transformer": _embedding(names)}


def _ensemble(correctors: dict[str, harness.Corrector]) -> harness.Corrector:
    """The weighted vote of the correctors."""

    def one(inputs: DataFrame) -> DataFrame:
        votes = None
        for name, corrector in correctors.items():
            own = harness.answers(corrector, inputs).select(F.col("input").alias("key"), F.lit(name).alias("model"), "candidate", "confidence")
            votes = own if votes is None else votes.unionByName(own)
        return cascade.vote(votes).select(F.col("key").alias("input"), "candidate", F.col("score").alias("confidence"), F.lit("ensemble").alias("method"))

    return one


@query()
def ensemble_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hybrid ensemble over real correctors: weighted ratio, naive Bayes, n-gram vectors."""
    return harness.answers(_ensemble(_correctors(spark, sf_dir)), _inputs(spark, sf_dir)).select("input", "candidate", "confidence")


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's faulty name, by kind of fault, with the name it should be."""
    kind = F.element_at(F.array(*[F.lit(k) for k in ("none", "lost_letter", "swapped_letters", "misread_and_added")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(kind.alias("kind"), F.expr(FAULTY).alias("input"), F.col("p_name").alias("expected"))


@query()
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, coverage and their product of each corrector and the ensemble over all parts, the best first."""
    cases = _cases(spark, sf_dir)
    # each corrector is asked once: the ensemble votes over the same answers
    given = {name: lambda inputs, found=kept(harness.answers(c, cases)): found for name, c in _correctors(spark, sf_dir).items()}
    rows = harness.tried(given | {"ensemble": _ensemble(given)}, cases)
    return cascade.accuracy(rows, "actual", "expected", "corrector").orderBy(F.desc("pseudo_f1"), "corrector")


def _first_letter(text: str) -> tuple[str | None, float, str]:
    """A plug-in as users write them: it knows one fault, and has one of its own."""
    if text.startswith("green"):
        raise ValueError("no green ones")
    return (text.rstrip("x").replace("0", "o"), 0.8, "plain") if text.endswith("x") else (None, 0.0, "plain")


@query(f"""WITH c AS (SELECT ['none', 'lost_letter', 'swapped_letters', 'misread_and_added'][p_partkey % 4 + 1] AS kind, {FAULTY} AS input, p_name AS expected FROM part),
    l AS ({LEV}), f AS (SELECT DISTINCT input, CASE WHEN input LIKE 'green%' THEN NULL WHEN input LIKE '%x' THEN replace(rtrim(input, 'x'), '0', 'o') END AS candidate, input LIKE 'green%' AS error FROM c),
    a AS (SELECT 'as_it_is' AS corrector, kind, expected, input AS actual, false AS error FROM c UNION ALL SELECT 'edit_distance', kind, expected, candidate, false FROM c LEFT JOIN l USING (input)
    UNION ALL SELECT 'plug_in', kind, expected, candidate, error FROM c JOIN f USING (input) UNION ALL SELECT 'in_a_row', kind, expected, COALESCE(f.candidate, l.candidate), false FROM c JOIN f USING (input) LEFT JOIN l USING (input))
    SELECT corrector, kind, COUNT(*) AS total, CAST(count_if(NOT error AND actual IS NOT DISTINCT FROM expected) AS BIGINT) AS passed, CAST(count_if(NOT error AND actual IS DISTINCT FROM expected) AS BIGINT) AS failed, CAST(count_if(error) AS BIGINT) AS errors FROM a GROUP BY 1, 2""")
def corrector_harness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correctors of every kind tried on all parts: an expression, a join, a plugged-in function, and two of them in a row."""
    names = _names(spark, sf_dir)
    by_distance: harness.Corrector = lambda inputs: similarity.first_levenshtein(inputs, names)
    plug_in = harness.of_function(_first_letter)
    tried = harness.tried({"as_it_is": harness.of_column(lambda x: F.struct(x.alias("corrected"), F.lit(1.0).alias("confidence")), "none"), "edit_distance": by_distance, "plug_in": plug_in, "in_a_row": harness.fallback([plug_in, by_distance])}, _cases(spark, sf_dir))
    n = lambda s: F.count_if(F.col("status") == s)
    return tried.groupBy("corrector", "kind").agg(F.count("*").alias("total"), n("PASSED").alias("passed"), n("FAILED").alias("failed"), n("ERROR").alias("errors"))


def _accuracy_sql(by: str) -> str:
    return f"""SELECT {by}ROUND(COALESCE(count_if(predicted = actual) / nullif(COUNT(predicted), 0), 0), 6) AS accuracy, ROUND(COUNT(predicted) / COUNT(*), 6) AS coverage,
    ROUND(COALESCE(count_if(predicted = actual) / nullif(COUNT(predicted), 0), 0) * (COUNT(predicted) / COUNT(*)), 6) AS pseudo_f1, COUNT(*) AS n FROM {PREDICTED}"""


@query(_accuracy_sql(""))
def eval_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.accuracy(_predicted(spark, sf_dir), "predicted", "actual")


@query(_accuracy_sql("p_type, ") + " GROUP BY p_type")
def eval_accuracy_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.accuracy(_predicted(spark, sf_dir), "predicted", "actual", "p_type")


@query(f"SELECT kind, ROUND(count_if(predicted = actual) / COUNT(predicted), 6) AS accuracy FROM (SELECT *, CASE position % 2 WHEN 0 THEN 'rule' ELSE 'ml' END AS kind FROM {PREDICTED}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def model_comparison_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _predicted(spark, sf_dir).withColumn("kind", F.when(F.col("position") % 2 == 0, "rule").otherwise("ml"))
    return cascade.accuracy(own, "predicted", "actual", "kind").select("kind", "accuracy").orderBy(F.desc("accuracy"), "kind").limit(1)


@query("SELECT p_partkey, COALESCE(CASE t WHEN 'toyot' THEN 'toyota' WHEN 'hond' THEN 'honda' WHEN 'civicy' THEN 'civic' WHEN 'camr' THEN 'camry' END, t) AS corrected, CAST(CASE WHEN t IN ('toyot', 'hond', 'civicy', 'camr') THEN 0.9 ELSE 0.1 END AS DOUBLE) AS confidence FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'toyot' WHEN 1 THEN 'hond' WHEN 2 THEN 'civicy' WHEN 3 THEN 'camr' ELSE p_name END AS t FROM part)")
def framework_corrector(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.expr("CASE p_partkey % 5 WHEN 0 THEN 'toyot' WHEN 1 THEN 'hond' WHEN 2 THEN 'civicy' WHEN 3 THEN 'camr' ELSE p_name END")
    return table(spark, sf_dir, "part").select("p_partkey", cascade.framework_corrector(t).alias("c")).select("p_partkey", "c.corrected", "c.confidence")


@query()
def extract_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.extract_one(_inputs(spark, sf_dir), _names(spark, sf_dir))


@query()
def rule_corrector_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule corrector over all faulty names: accuracy, coverage and their product."""
    truth = table(spark, sf_dir, "part").select(F.expr(FAULTY).alias("input"), F.col("p_name").alias("actual"))
    found = similarity.extract_one(_inputs(spark, sf_dir), _names(spark, sf_dir)).withColumnRenamed("candidate", "predicted")
    return cascade.accuracy(truth.join(found, "input", "left"), "predicted", "actual")


@query("SELECT p_partkey, COALESCE(CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 3 = 1 THEN NULL END, CASE WHEN p_partkey % 2 = 0 THEN p_type END, p_name) AS first_available FROM part")
def first_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first corrector that has an answer; a blank is none."""
    key = F.col("p_partkey")
    answers = [F.when(key % 3 == 0, F.col("p_brand")).when(key % 3 == 2, " "), F.when(key % 2 == 0, F.col("p_type")), F.col("p_name")]
    return table(spark, sf_dir, "part").select("p_partkey", cascade.first_available(answers).alias("first_available"))


@query("""SELECT 'ocr_' || a || '_to_' || b AS name, 'ocr_substitution' AS pattern_type, a AS from_char, b AS to_char, (SELECT CAST(count_if(contains(p_name, a)) AS BIGINT) FROM part) AS n_names, (SELECT MIN(replace(p_name, a, b)) FROM part WHERE contains(p_name, a)) AS example
    FROM (VALUES ('o', '0'), ('0', 'o'), ('i', '1'), ('1', 'i'), ('l', '1'), ('s', '5'), ('5', 's'), ('b', '6'), ('6', 'b')) t(a, b)""")
def pattern_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each misread character with the names of all parts that it may stand in, from one scan."""
    return cascade.pattern_uses(table(spark, sf_dir, "part"), "p_name")


@query(f"SELECT input, candidate FROM (SELECT *, row_number() OVER (PARTITION BY input ORDER BY confidence DESC, candidate DESC) AS k FROM (SELECT input, candidate, 1 - levenshtein(input, candidate) / CAST(greatest(length(input), length(candidate), 1) AS DOUBLE) AS confidence FROM {INPUTS}, {NAMES} WHERE {BOUND.format(0.6)}) WHERE confidence >= 0.6) WHERE k = 1 AND confidence >= 0.8")
def best_suggestion(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similarity.suggestions(_inputs(spark, sf_dir), _names(spark, sf_dir), score=similarity.levenshtein_score, reverse=False)
    return found.where("rank = 1 and confidence >= 0.8").select("input", "candidate")
