"""The correction cascade, its mappings, votes of several correctors, and their evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Weights of the correctors, the patterns of one misread character each, corrections by name.
VOTE_WEIGHTS = {"rule": 0.3, "ml": 0.5, "transformer": 0.2}
MISREAD = {"o": "0", "0": "o", "i": "1", "1": "i", "l": "1", "s": "5", "5": "s", "b": "6", "6": "b"}
FRAMEWORK_CORRECTIONS = {"toyot": "toyota", "hond": "honda", "civicy": "civic", "camr": "camry"}


def correct(inputs: DataFrame, direct: DataFrame, fuzzy: DataFrame, later: list[tuple[str, DataFrame]], threshold: float = 0.7) -> DataFrame:
    """(input, corrected, confidence, method, was_corrected) of each row of ``inputs`` (key, input).

    Stages in order: no input, direct mapping, fuzzy mapping at the threshold, then each of ``later``, a table
    (input, candidate, confidence) computed for what may still be open. Mappings: (input, correction, confidence).
    """
    text = F.trim(F.lower(F.col("input")))
    out = inputs.withColumn("t", F.coalesce(text, F.lit("")))
    stages: list[Column] = [F.when(F.col("t") == "", F.struct(F.lit("").alias("corrected"), F.lit(0.0).alias("confidence"), F.lit("no_input").alias("method")))]
    named = [("direct_mapping", direct.withColumnRenamed("correction", "candidate"), 0.0), ("fuzzy_mapping", fuzzy.withColumnRenamed("correction", "candidate"), threshold), *[(m, t, 0.0) for m, t in later]]
    for k, (method, table, least) in enumerate(named):
        own = table.select(F.col("input").alias("t"), F.struct(F.col("candidate").alias("corrected"), F.col("confidence").cast("double").alias("confidence"), F.lit(method).alias("method")).alias(f"s{k}"))
        out = out.join(own, "t", "left")
        stages.append(F.when(F.col(f"s{k}.confidence") >= least, F.col(f"s{k}")))
    stages.append(F.struct(F.col("t").alias("corrected"), F.lit(0.0).alias("confidence"), F.lit("no_correction").alias("method")))
    done = out.withColumn("r", F.coalesce(*stages))
    changed = ~F.lower(F.col("r.corrected")).eqNullSafe(F.lower(F.coalesce("input", F.lit(""))))
    return done.select("key", "input", "r.corrected", "r.confidence", "r.method", changed.alias("was_corrected"))


def later_stages(learned: DataFrame, close: DataFrame, distance: DataFrame, threshold: float = 0.7, with_probability: bool = True) -> list[tuple[str, DataFrame]]:
    """The stages after the mappings: the learned corrector from the threshold on (without probabilities its label counts 0.7),
    the closest by weighted ratio, the first within the edit distance. Each table: (input, candidate, confidence)."""
    if with_probability:
        told = ("ml_model", learned.where(F.col("confidence") >= threshold))
    else:
        told = ("ml_model_simple", learned.withColumn("confidence", F.lit(0.7)))
    return [told, ("fuzzy_fallback", close), ("rule_based_levenshtein", distance)]


def unresolved(inputs: DataFrame, *mappings: DataFrame) -> DataFrame:
    """Distinct inputs that no mapping knows: what the costly stages have to look at."""
    out = inputs.select(F.trim(F.lower(F.col("input"))).alias("input")).where("input <> ''").distinct()
    for m in mappings:
        out = out.join(m.select("input"), "input", "left_anti")
    return out


def build_mappings(predictions: DataFrame) -> DataFrame:
    """(input, correction, confidence, kind) of correct predictions (input, predicted, actual, confidence, position): direct from 0.7, fuzzy from 0.5; of one input the last."""
    ok = predictions.where((F.col("predicted") == F.col("actual")) & (F.col("confidence") >= 0.5)).withColumn("kind", F.when(F.col("confidence") >= 0.7, "direct").otherwise("fuzzy"))
    last = ok.groupBy("input", "kind").agg(F.max_by(F.struct(F.col("predicted").alias("correction"), "confidence"), "position").alias("m"))
    return last.select("input", "m.correction", "m.confidence", "kind")


def pattern_mappings(spark: SparkSession) -> DataFrame:
    """(name, pattern_type, from_char, to_char) of the misread characters."""
    rows = [(f"ocr_{a}_to_{b}", "ocr_substitution", a, b) for a, b in MISREAD.items()]
    return spark.createDataFrame(rows, "name string, pattern_type string, from_char string, to_char string")


def pattern_uses(df: DataFrame, column: str) -> DataFrame:
    """``pattern_mappings`` with the number of texts that hold the character, and the first of these as it would be misread."""
    x = F.col(column)
    of = lambda a, b: F.struct(F.lit(f"ocr_{a}_to_{b}").alias("name"), F.lit("ocr_substitution").alias("pattern_type"), F.lit(a).alias("from_char"), F.lit(b).alias("to_char"), F.count_if(F.contains(x, F.lit(a))).alias("n_names"), F.min(F.when(F.contains(x, F.lit(a)), F.replace(x, F.lit(a), F.lit(b)))).alias("example"))
    return df.agg(F.array(*[of(a, b) for a, b in MISREAD.items()]).alias("patterns")).select(F.inline("patterns"))


def first_available(answers: list[Column]) -> Column:
    """The answer of the first corrector that has one, null or blank being none."""
    return F.coalesce(*[F.when(F.trim(a.cast("string")) != "", a) for a in answers])


def vote(votes: DataFrame, weights: dict[str, float] = VOTE_WEIGHTS, threshold: float = 0.6) -> DataFrame:
    """(key, candidate, score) by votes (key, model, candidate, confidence): weight x confidence summed by candidate, the largest over all weights; ties to the first name."""
    w = F.create_map(*[F.lit(x) for p in weights.items() for x in p])
    sums = votes.groupBy("key", "candidate").agg(F.sum(F.element_at(w, F.col("model")) * F.col("confidence")).alias("s"))
    best = sums.groupBy("key").agg(F.max("s").alias("top"), F.min_by("candidate", F.struct(-F.round("s", 9), F.col("candidate"))).alias("candidate"))
    score = F.round(F.col("top") / sum(weights.values()), 6)
    return best.select("key", F.when(score >= threshold, F.col("candidate")).alias("candidate"), score.alias("score"))


def accuracy(df: DataFrame, predicted: str, actual: str, by: str | None = None) -> DataFrame:
    """Accuracy over the predicted rows, coverage over all, and their product."""
    has = F.col(predicted).isNotNull()
    right = F.count_if(has & (F.col(predicted) == F.col(actual)))
    acc = F.coalesce(F.try_divide(right.cast("double"), F.count_if(has).cast("double")), F.lit(0.0))
    cov = F.coalesce(F.try_divide(F.count_if(has).cast("double"), F.count("*").cast("double")), F.lit(0.0))
    grouped = df.groupBy(by) if by else df.groupBy()
    return grouped.agg(F.round(acc, 6).alias("accuracy"), F.round(cov, 6).alias("coverage"), F.round(acc * cov, 6).alias("pseudo_f1"), F.count("*").alias("n"))


def framework_corrector(x: Column) -> Column:
    """struct(corrected, confidence): four fixed corrections at 0.9, anything else as it is at 0.1."""
    table = F.create_map(*[F.lit(v) for p in FRAMEWORK_CORRECTIONS.items() for v in p])
    hit = F.try_element_at(table, F.lower(x))
    return F.struct(F.coalesce(hit, x).alias("corrected"), F.when(hit.isNotNull(), 0.9).otherwise(0.1).alias("confidence"))
