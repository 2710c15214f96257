"""String similarity, fuzzy matching to a master table, and error classes.

A pair is scored once for each distinct value: distinct inputs meet distinct candidates through an exact index
(``candidates``), by edit distance where that is the score, by letters in common otherwise, and results join back. The index
loses no pair that reaches the cutoff, and no table meets another whole.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendwright.functions.gestalt import ratios
from mendwright.functions.names import jaro_winkler
from mendwright.operators import candidates, rules, years

# Weights of brand, model and year in a match, its threshold, and where a typo ends.
WEIGHTS, THRESHOLD, TYPO = (0.4, 0.4, 0.2), 0.8, 0.6


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(ratios(a.tolist(), b.tolist()), dtype="float64")


def gestalt(a: Column, b: Column) -> Column:
    """The longest-matching-blocks ratio of two strings in this order (it is not symmetric); 0 if either is empty."""
    return F.pandas_udf(_ratios, "double")(a, b)


def levenshtein_score(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)).cast("double")


def candidate_pairs(inputs: DataFrame, master: DataFrame, cutoff: float, score=None) -> DataFrame:
    """(input, candidate, position) pairs that may reach the cutoff (above 0). inputs: (input); master: (candidate, position).

    Neither the gestalt ratio nor 1 - distance / length exceeds 2 * (letters in common) / (sum of the lengths); where the second one is the
    ``score``, pairs within the distance are found instead.
    """
    if score is levenshtein_score and cutoff < 1:
        return candidates.distance_pairs(inputs, master, 1 - cutoff).drop("distance")
    return candidates.letter_pairs(inputs, master, cutoff)


def suggestions(inputs: DataFrame, master: DataFrame, n: int = 3, cutoff: float = 0.6, score=gestalt, reverse: bool = True) -> DataFrame:
    """(input, candidate, confidence, rank): the n best candidates at or above the cutoff, ties to the larger candidate.

    ``reverse`` filters by the score of (candidate, input) and reports that of (input, candidate).
    """
    pairs = candidate_pairs(inputs, master, cutoff, score)
    scored = pairs.withColumn("confidence", score(F.col("input"), F.col("candidate")))
    scored = scored.withColumn("filtered", score(F.col("candidate"), F.col("input")) if reverse else F.col("confidence")).where(F.col("filtered") >= cutoff)
    order = Window.partitionBy("input").orderBy(F.desc("filtered"), F.desc("candidate"))
    kept = scored.withColumn("k", F.row_number().over(order)).where(F.col("k") <= n)
    final = Window.partitionBy("input").orderBy(F.desc("confidence"), "k")
    return kept.select("input", "candidate", "confidence", F.row_number().over(final).alias("rank"))


def first_levenshtein(inputs: DataFrame, master: DataFrame, share: float = 0.3, threshold: float = 0.7) -> DataFrame:
    """(input, candidate, confidence): the first candidate within the distance, both longer than two characters."""
    pairs = candidates.distance_pairs(inputs.where(F.length("input") > 2), master.where(F.length("candidate") > 2), min(share, 1 - threshold))
    d = F.col("distance")
    longest = F.greatest(F.length("input"), F.length("candidate"))
    ok = pairs.withColumn("confidence", 1 - d / longest.cast("double")).where((d <= share * longest) & (F.col("confidence") >= threshold))
    best = ok.groupBy("input").agg(F.min_by(F.struct("candidate", "confidence"), "position").alias("b"))
    return best.select("input", "b.candidate", "b.confidence")


def closest_name(inputs: DataFrame, master: DataFrame, threshold: float = 0.9, alike: float = 0.8) -> DataFrame:
    """(input, candidate, similarity): the candidate with the highest Jaro-Winkler similarity at or above the threshold, ties to the first name.

    Of pairs whose lengths are ``alike`` (twice the smaller by their sum). With m letters in common Jaro is (m/a + m/b + 1) / 3 at most, and
    the first letters add 0.4 of the rest at most, so 2 * m / (a + b) can't be below the bound that the threshold implies.
    """
    jaro_least = (threshold - 0.4) / 0.6
    a, b = F.length("input"), F.length("candidate")
    # m/a + m/b >= 3j - 1 with a, b no less alike than told: m/a + m/b <= 2m/(a+b) * 2/(alike * (2 - alike))
    least = max(0.01, (3 * jaro_least - 1) / 2 * alike * (2 - alike))
    pairs = candidates.letter_pairs(inputs, master, least).where(2 * F.least(a, b) >= alike * (a + b))
    scored = pairs.withColumn("similarity", F.round(jaro_winkler(F.col("input"), F.col("candidate")), 9)).where(F.col("similarity") >= threshold)
    best = scored.groupBy("input").agg(F.min_by(F.struct("candidate", "similarity"), F.struct(-F.col("similarity"), "candidate")).alias("b"))
    return best.select("input", "b.candidate", "b.similarity")


def best_matches(users: DataFrame, master: DataFrame, score=gestalt, threshold: float = THRESHOLD, normalize_master: bool = False) -> DataFrame:
    """Each user row (key, brand, model, year) with its best master row: 0.4 brand + 0.4 model + 0.2 if the year is in range.

    The master keeps its texts as they are unless ``normalize_master``; the first master row wins ties, so master
    rows carry a ``position`` of any type with an order. Brand and model are scored once for each distinct pair.
    """
    norm = lambda c: years.normalized_text(F.col(c))
    u = users.select("*", norm("brand").alias("nb"), norm("model").alias("nm"), years.match_year(F.col("year").cast("string")).alias("ny"))
    m = master.select(F.col("brand").alias("mb"), F.col("model").alias("mm"), "year_start", "year_end", "position", *[(norm(c) if normalize_master else F.col(c)).alias(a) for c, a in (("brand", "cb"), ("model", "cm"))])
    wb, wm, wy = WEIGHTS
    # without the year a match needs (threshold - wy) of brand and model, so neither may be below this
    least = min((threshold - wy - wm) / wb, (threshold - wy - wb) / wm) - 1e-9
    if least <= 0:
        raise ValueError(f"brand and model must both count: the threshold has to be above {wy + max(wb, wm)}")

    def scored_pairs(mine: str, theirs: str, name: str) -> DataFrame:
        """Distinct values meet distinct candidates."""
        pairs = candidate_pairs(u.select(F.col(mine).alias("input")).distinct(), m.select(F.col(theirs).alias("candidate")).distinct().withColumn("position", F.lit(0)), least, score)
        return pairs.select(F.col("input").alias(mine), F.col("candidate").alias(theirs), score(F.col("input"), F.col("candidate")).alias(name)).where(F.col(name) >= least)

    brands, models = scored_pairs("nb", "cb", "sb"), scored_pairs("nm", "cm", "sm")
    # the models first, for they choose most; then their master rows, then the brands of these
    base = wb * F.col("sb") + wm * F.col("sm")
    # few distinct texts make many pairs: they are dealt out first, and stay so until each has its list
    parts = int(users.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = u.select("nb", "nm").distinct().repartition(parts, "nb", "nm").join(models, "nm").join(m, "cm").join(brands, ["nb", "cb"]).withColumn("base", base).where(F.col("base") >= threshold - wy - 1e-9)
    # of master rows that cover the same years the best with the year and the best without it are enough (bases that differ in their last
    # bit may be equal once the year's share is added); the years that an input can have bound how many are left
    first, last = F.greatest("year_start", F.lit(years.LOW_MATCH)), F.least("year_end", F.lit(years.HIGH_MATCH))
    some = F.col("year_start").isNotNull() & F.col("year_end").isNotNull() & (first <= last)
    row = F.struct("base", "position", "mb", "mm", "year_start", "year_end", "sb", "sm")
    top = lambda score: F.min_by(row, F.struct(-score, "position"))
    ranges = texts.groupBy("nb", "nm", F.when(some, first).alias("first"), F.when(some, last).alias("last")).agg(F.array_distinct(F.array(top(F.col("base")), top(F.col("base") + wy))).alias("rows"))
    lists = ranges.groupBy("nb", "nm").agg(F.flatten(F.collect_list("rows")).alias("rows"))

    def judged(r: Column) -> Column:
        inside = F.coalesce(F.col("ny").between(r["year_start"], r["year_end"]), F.lit(False))
        return F.struct((-(r["base"] + F.when(inside, wy).otherwise(0.0))).alias("order"), r["position"].alias("position"), r.alias("row"))

    best = F.array_min(F.filter(F.transform("rows", judged), lambda x: x["order"] <= -threshold))
    found = u.join(lists, ["nb", "nm"], "left").withColumn("_best", best).drop("rows")
    row = F.col("_best.row")
    match = F.struct(*[row[c].alias(c) for c in ("mb", "mm", "year_start", "year_end")], (-F.col("_best.order")).alias("score"), row["sb"].alias("sb"), row["sm"].alias("sm"))
    return found.withColumn("match", F.when(F.col("_best").isNotNull(), match)).drop("_best")


def error_types(df: DataFrame, plate: Column) -> DataFrame:
    """Adds error_types (joined) and has_errors to best_matches' rows."""
    m = F.col("match")
    typo = lambda same, s, name: F.when(~same, F.when(s > TYPO, f"typo_{name}").otherwise(f"wrong_{name}"))
    found = F.array_compact(F.array(
        F.when(~rules.plate_strict(plate), "plate_format_error"),
        F.when(m.isNotNull(), typo(F.col("nb") == m["mb"], m["sb"], "brand")),
        F.when(m.isNotNull(), typo(F.col("nm") == m["mm"], m["sm"], "model")),
        F.when(m.isNotNull() & F.col("ny").isNotNull() & ~F.col("ny").between(m["year_start"], m["year_end"]), "invalid_year"),
        F.when(m.isNotNull() & F.col("ny").isNull(), "missing_year"),
        F.when(m.isNull(), "no_match_found"),
    ))
    joined = F.when(F.size(found) == 0, "correct").otherwise(F.array_join(found, ", "))
    return df.withColumns({"error_types": joined, "has_errors": F.size(found) > 0, "confidence_score": F.coalesce(m["score"], F.lit(0.0))})


def error_distribution(df: DataFrame) -> DataFrame:
    token = F.explode(F.split("error_types", r",\s*"))
    return df.select(token.alias("error")).where("error <> 'correct'").groupBy("error").agg(F.count("*").alias("n"))


def comprehensive(users: DataFrame, master: DataFrame, threshold: float = 0.7, score=gestalt) -> DataFrame:
    """Each row (key, brand, model, year) corrected, with ``corrections`` (field, original, corrected, confidence, changed).

    An exact match is a correction of confidence 1 whose ``changed`` is false. An empty master changes nothing.
    """
    out = users
    for c in ("brand", "model"):
        values = users.select(F.col(c).alias("input")).where(F.col(c).isNotNull()).distinct()
        found = suggestions(values, master.select(F.col(c).alias("candidate")).where(F.col(c).isNotNull()).distinct().withColumn("position", F.lit(0)), score=score).where((F.col("rank") == 1) & (F.col("confidence") >= threshold))
        out = out.join(found.select(F.col("input").alias(c), F.col("candidate").alias(f"new_{c}"), F.col("confidence").alias(f"conf_{c}")), c, "left")
    out = years.validated(out.withColumn("year", F.col("year").cast("string")), "year", threshold)

    def entry(c: str, when: Column, new: Column, conf: Column) -> Column:
        return F.when(when, F.struct(F.lit(c).alias("field"), F.col(c).alias("original"), new.alias("corrected"), conf.alias("confidence"), (~F.col(c).eqNullSafe(new)).alias("changed")))

    entries = F.array_compact(F.array(
        *[entry(c, F.col(f"new_{c}").isNotNull(), F.col(f"new_{c}"), F.col(f"conf_{c}")) for c in ("brand", "model")],
        entry("year", F.col("year_correction_applied"), F.col("year_validated"), F.col("year_confidence")),
    ))
    return out.select("key", F.coalesce("new_brand", "brand").alias("brand"), F.coalesce("new_model", "model").alias("model"), F.when(F.col("year_correction_applied"), F.col("year_validated")).otherwise(F.col("year")).alias("year"), entries.alias("corrections"))


def correction_rate(corrected: DataFrame) -> DataFrame:
    n = F.count_if(F.size("corrections") > 0)
    return corrected.agg(F.count("*").alias("total"), n.alias("corrected"), F.coalesce(F.try_divide(n.cast("double"), F.count("*").cast("double")), F.lit(0.0)).alias("rate"))


def _percent(a: str, b: str) -> int:
    return round(100 * SequenceMatcher(None, a, b).ratio()) if a and b else 0


def _part_percent(a: str, b: str) -> int:
    """The best ratio of the shorter string with as long a part of the longer one, begun where a matching block puts it."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 0
    best = 0.0
    for i, j, _ in SequenceMatcher(None, short, long).get_matching_blocks():
        part = long[max(0, j - i) : max(0, j - i) + len(short)]
        best = max(best, SequenceMatcher(None, short, part).ratio())
    return 100 if best > 0.995 else round(100 * best)


def _token_percents(a: str, b: str, ratio) -> tuple[int, int]:
    """(ratio of the sorted words, best ratio among the shared words and these with the words of either)."""
    x, y = a.split(), b.split()
    same = " ".join(sorted(set(x) & set(y)))
    one, two = (f"{same} {' '.join(sorted(set(p) - set(q)))}".strip() for p, q in ((x, y), (y, x)))
    return ratio(" ".join(sorted(x)), " ".join(sorted(y))), max(ratio(same, one), ratio(same, two), ratio(one, two))


def weighted_percent(a: str | None, b: str | None) -> int:
    """The weighted ratio of two strings, 0 to 100, for lower-cased letters and digits: the whole ratio, or 0.95 of those of the
    words; where one is 1.5 times as long or longer, those of parts count, by 0.9, or by 0.6 from 8 times on."""
    a, b = (" ".join("".join(c if c.isalnum() or c == "_" else " " for c in (x or "")).lower().split(" ")).strip() for x in (a, b))
    if not a or not b:
        return 0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    base = _percent(a, b)
    if longer < 1.5:
        return round(max(base, *(0.95 * t for t in _token_percents(a, b, _percent))))
    scale = 0.6 if longer > 8 else 0.9
    return round(max(base, scale * _part_percent(a, b), *(0.95 * scale * t for t in _token_percents(a, b, _part_percent))))


def _weighted(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([weighted_percent(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def extract_one(inputs: DataFrame, master: DataFrame, threshold: int = 70) -> DataFrame:
    """(input, candidate, score): each input's best candidate by weighted ratio at or above the threshold, ties to the first one.

    Pairs that share a word are scored, and others if they have enough letters in common: without shared words no ratio exceeds
    2c / (c + shorter length), with c letters in common and the lengths of the distinct words.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]", " "), " "), lambda w: w != ""))
    x = inputs.where(F.col("input").isNotNull()).withColumn("x_words", words("input"))
    y = master.where(F.col("candidate").isNotNull()).withColumn("y_words", words("candidate"))
    shorter = F.least(*[F.length(F.array_join(w, " ")) for w in ("x_words", "y_words")])
    least = (threshold - 1) / 100  # what rounds to the threshold
    lowered = lambda df, c: df.withColumns({f"own_{c}": F.col(c), c: F.lower(c)})
    pairs = candidates.word_pairs(lowered(x, "input"), lowered(y, "candidate"), least)
    scored = pairs.withColumn("score", F.pandas_udf(_weighted, "int")(F.col("own_input"), F.col("own_candidate"))).where(F.col("score") >= threshold)
    best = scored.groupBy(F.col("own_input").alias("input")).agg(F.min_by(F.struct(F.col("own_candidate").alias("candidate"), "score"), F.struct(-F.col("score"), "position")).alias("b"))
    return best.select("input", "b.candidate", "b.score")


def enhanced_years(users: DataFrame, master_years: DataFrame | None, threshold: float = 0.7, cutoff: float = 0.6, score=gestalt, reverse: bool = True) -> DataFrame:
    """Years (key, year) validated, then, where that changed them, brought to the master's most similar year above the threshold.

    Adds final_year, corrections (method, from, to, reason, confidence), methods and confidence. master_years: (candidate).
    """
    own = users.select("key", F.col("year").cast("string").alias("year"))
    v = years.validated(own.select("year").distinct(), "year", threshold)  # a text is read once, however many rows have it
    v = v.withColumn("t", F.when(F.col("year_correction_applied"), F.col("year_validated")))
    if master_years is None:
        v = v.withColumn("s", F.lit(None).cast("struct<candidate:string,confidence:double>"))
    else:
        changed = v.where(F.col("t") != F.col("year_original")).select(F.col("t").alias("input")).distinct()
        near = suggestions(changed, master_years.where("candidate is not null").distinct().withColumn("position", F.lit(0)), 1, cutoff, score, reverse)
        near = near.where((F.col("confidence") > threshold) & (F.col("candidate") != F.col("input"))).select(F.col("input").alias("t"), F.struct("candidate", "confidence").alias("s"))
        v = v.join(near, "t", "left")
    entry = lambda when, *x: F.when(when, F.struct(*[c.alias(n) for n, c in zip(("method", "from", "to", "reason", "confidence"), x, strict=True)]))
    found = F.array_compact(F.array(
        entry(F.col("year_correction_applied"), F.lit("year_validation"), F.col("year_original"), F.col("year_validated"), F.col("year_correction_reason"), F.col("year_confidence")),
        entry(F.col("s").isNotNull(), F.lit("autocorrect"), F.col("t"), F.col("s.candidate"), F.lit("similarity_match"), F.col("s.confidence")),
    ))
    done = v.select("year", "year_original", F.coalesce("s.candidate", "t", "year_original").alias("final_year"), found.alias("corrections")).withColumns({
        "methods": F.array_join(F.transform("corrections", lambda x: x["method"]), ","),
        "confidence": F.coalesce(F.array_min(F.transform("corrections", lambda x: x["confidence"])), F.lit(1.0)),
    })
    return own.join(done.withColumnRenamed("year", "_year"), F.col("year").eqNullSafe(F.col("_year"))).drop("year", "_year")


def enhanced_statistics(corrected: DataFrame) -> DataFrame:
    """One row over ``enhanced_years``: counts by kind of correction, and their rates."""
    has = lambda m: F.exists("corrections", lambda x: x["method"] == m)
    future = F.exists("corrections", lambda x: F.contains(x["reason"], F.lit("future_year_corrected")))
    total = F.count("*")
    counts = [total.alias("total_records"), F.count_if(future).alias("future_years_corrected"), F.count_if(has("year_validation")).alias("validation_corrections"), F.count_if(has("autocorrect")).alias("autocorrect_corrections"), F.count_if(F.size("corrections") == 0).alias("no_corrections")]
    per = lambda n: F.round(F.coalesce(F.try_divide(n.cast("double"), F.col("total_records").cast("double")), F.lit(0.0)), 6)
    return corrected.agg(*counts).withColumns({"correction_rate": per(F.col("validation_corrections") + F.col("autocorrect_corrections")), "future_rate": per(F.col("future_years_corrected"))})


def processed_inputs(users: DataFrame, master: DataFrame, score=gestalt) -> DataFrame:
    """The 14 columns of a user input's report (plate, brand, model, year as given and normalised, the match, errors). users: (key, plate, brand, model, year)."""
    found = error_types(best_matches(users, master, score), F.col("plate"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return found.select(
        *[text(c).alias(f"user_input_{c}") for c in ("plate", "brand", "model", "year")], F.col("nb").alias("normalized_brand"), F.col("nm").alias("normalized_model"), F.col("ny").alias("normalized_year"),
        *[text(f"match.{m}").alias(f"matched_{n}") for m, n in (("mb", "brand"), ("mm", "model"), ("year_start", "year_start"), ("year_end", "year_end"))],
        "confidence_score", "error_types", "has_errors",
    )
