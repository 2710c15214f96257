"""Exact candidate indexes for fuzzy matching: pairs meet by equal keys, none that may match is lost, and no table meets another whole.

``letter_pairs`` serves every score that is bounded by letters in common (the gestalt ratio, 1 - distance / length, ratios of
words). A string's letters, numbered by occurrence (the second ``o`` is another token than the first), are put in one order for
all strings, rare ones first. Strings of lengths a and b that have ``o(a, b)`` letters in common at least share one among the first
a - o + 1 tokens of the one and b - o + 1 of the other; so the index holds a candidate under (a, b, token) for all
lengths a that it may meet, and inputs look themselves up the same way. A pair counts where it meets first: at the first token of both.

``distance_pairs`` serves edit distances bounded by a share of the longer length. A candidate of length b is cut into as many
segments as edits are allowed, and one: one of them stands unchanged in the input, moved by so many places at most
as the edits allow. The index holds segments under (length, edits, number of the segment, text).

Keys that many strings share make large groups on both sides; the joins are plain shuffle joins, which adaptive execution
splits within a key. Letters and lengths are counted in characters. Defined cases: null and empty strings meet nothing; repeated
strings are the caller's (both sides are expected distinct).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendwright.functions.expr import once

#: So many of the most frequent letters are told apart when tokens are put in order; all others come first.
RANKED = 128


def letter_counts(df: DataFrame, c: str) -> Column:
    """How often each frequent letter occurs in the column: a map, as a scalar subquery."""
    letters = df.select(F.explode(F.split(F.col(c), "")).alias("letter")).where("letter <> ''").groupBy("letter").agg(F.count("*").alias("n"))
    most = letters.orderBy(F.desc("n"), "letter").limit(RANKED)
    return most.agg(F.map_from_entries(F.collect_list(F.struct("letter", "n")))).scalar()


def letter_tokens(c: str, counts: str) -> Column:
    """The letters of a string numbered by occurrence, as hashes, rare ones first by the counts in column ``counts``."""
    letters = F.array_sort(F.filter(F.split(F.col(c), ""), lambda x: x != ""))

    def one(letters: Column) -> Column:
        def token(x: Column, i: Column) -> Column:
            occurrence = (i + 2 - F.array_position(letters, x)).cast("int")
            return F.struct((F.coalesce(F.try_element_at(F.col(counts), x), F.lit(0)) / occurrence).alias("often"), F.xxhash64(x, occurrence).alias("token"))

        return F.transform(F.array_sort(F.transform(letters, token)), lambda t: t["token"])

    return once(letters, one)


def _with_tokens(df: DataFrame, c: str, name: str, counts: Column) -> DataFrame:
    return df.where(F.length(c) > 0).withColumn(f"{name}_counts", counts).withColumn(name, letter_tokens(c, f"{name}_counts")).drop(f"{name}_counts")


def needed(a: Column, b: Column, cutoff: float) -> Column:
    """Letters that strings of these lengths have in common at least, if 2 * common >= cutoff * (a + b)."""
    return F.greatest(F.lit(1), F.ceil((a + b) * (cutoff / 2) - 1e-9).cast("int"))


def letter_pairs(inputs: DataFrame, master: DataFrame, cutoff: float) -> DataFrame:
    """The pairs of ``inputs`` (input, ...) and ``master`` (candidate, ...) with 2 * (letters in common) >= cutoff * (sum of the lengths), each once."""
    least = cutoff / (2 - cutoff)  # of the lengths of two strings that may match
    counts = letter_counts(master.select("candidate").distinct(), "candidate")
    length = F.length

    def keyed(df: DataFrame, c: str, name: str, mine_first: bool) -> DataFrame:
        own = _with_tokens(df, c, name, counts).withColumn(f"{name}_n", length(c))
        n = F.col(f"{name}_n")
        other = F.explode(F.sequence(F.greatest(F.lit(1), F.ceil(n * least - 1e-9)), F.floor(n / max(least, 1e-3) + 1e-9)).cast("array<int>")) if least > 0 else None
        met = own.withColumn("_other", other)
        first = F.slice(F.col(name), F.lit(1), F.greatest(F.lit(0), n - needed(n, F.col("_other"), cutoff) + 1))
        a, b = (n, F.col("_other")) if mine_first else (F.col("_other"), n)
        return met.withColumn("_token", F.explode(first)).withColumn("_key", F.xxhash64(a, b, "_token")).drop("_other", f"{name}_n")

    x, y = keyed(inputs, "input", "_x", True), keyed(master, "candidate", "_y", False).drop("_token")
    common = F.array_intersect("_x", "_y")
    met = x.join(y, "_key").withColumn("_common", common)
    total = length("input") + length("candidate")
    return met.where((F.try_element_at("_common", F.lit(1)) == F.col("_token")) & (2 * F.size("_common") >= cutoff * total - 1e-9)).drop("_key", "_token", "_x", "_y", "_common")


def word_pairs(inputs: DataFrame, master: DataFrame, least: float) -> DataFrame:
    """The pairs of ``inputs`` (input, x_words, ...) and ``master`` (candidate, y_words, ...) that share a word, or have 2 * common >= least * (common + shorter)
    letters in common, ``shorter`` being the smaller length of their joined words. Pairs without words aren't among them."""
    counts = letter_counts(master.select("candidate").distinct(), "candidate")

    def keyed(df: DataFrame, c: str, words: str, name: str, mine: str, theirs: str) -> DataFrame:
        own = _with_tokens(df, c, name, counts).withColumn(f"{name}_m", F.length(F.array_join(words, " "))).where(F.col(f"{name}_m") > 0)
        m = F.col(f"{name}_m")
        # at the smaller length of the two: strings of this length meet all that are as long or longer
        sides = lambda k: F.when(k == m, F.array(F.lit("=="), F.lit(mine))).otherwise(F.array(F.lit(theirs)))
        need = lambda k: F.greatest(F.lit(1), F.ceil(k * (least / (2 - least)) - 1e-9).cast("int"))
        prefix = lambda k: F.slice(F.col(name), F.lit(1), F.greatest(F.lit(0), F.size(name) - need(k) + 1))
        letters = F.flatten(F.transform(F.sequence(F.lit(1), m), lambda k: F.flatten(F.transform(sides(k), lambda s: F.transform(prefix(k), lambda t: F.struct(F.xxhash64(k, s, t).alias("_key"), t.alias("_token"), F.lit(False).alias("_word")))))))
        shared = F.transform(words, lambda w: F.struct(F.xxhash64(F.lit("word"), w).alias("_key"), F.xxhash64(w).alias("_token"), F.lit(True).alias("_word")))
        return own.select("*", F.inline(F.concat(shared, letters)))

    x, y = keyed(inputs, "input", "x_words", "_x", "<", ">"), keyed(master, "candidate", "y_words", "_y", ">", "<").drop("_token", "_word")
    met = x.join(y, "_key").withColumn("_same", F.array_intersect("x_words", "y_words")).withColumn("_common", F.array_intersect("_x", "_y"))
    by_word = F.col("_word") & (F.xxhash64(F.try_element_at("_same", F.lit(1))) == F.col("_token"))
    enough = 2 * F.size("_common") >= least * (F.size("_common") + F.least("_x_m", "_y_m")) - 1e-9
    by_letters = ~F.col("_word") & (F.size("_same") == 0) & (F.try_element_at("_common", F.lit(1)) == F.col("_token")) & enough
    return met.where(by_word | by_letters).drop("_key", "_token", "_word", "_same", "_common", "_x", "_y", "_x_m", "_y_m")


def _segment(b: Column, parts: Column, i: Column) -> tuple[Column, Column]:
    """(start, length) of segment i of a string of length b in so many parts; the last ones are longer by one."""
    size = F.floor(b / parts).cast("int")
    longer = i - (parts - (b - size * parts))
    return i * size + F.greatest(F.lit(0), longer), size + F.when(longer >= 0, 1).otherwise(0)


def distance_pairs(inputs: DataFrame, master: DataFrame, share: float) -> DataFrame:
    """The pairs of ``inputs`` (input, ...) and ``master`` (candidate, ...) with an edit distance of up to ``share`` (below 1) of the longer length, each once, with ``distance``."""
    edits = lambda n: F.floor(n * share + 1e-9).cast("int")
    shortest = lambda n: F.greatest(F.lit(1), F.ceil(n * (1 - share) - 1e-9).cast("int"))
    longest = lambda n: F.floor(n / (1 - share) + 1e-9).cast("int")

    a, b, t = F.col("_a"), F.col("_b"), F.col("_t")
    parts = F.least(t + 1, b)
    x = inputs.where(F.length("input") > 0).withColumn("_a", F.length("input")).withColumn("_b", F.explode(F.sequence(shortest(a), longest(a)))).withColumn("_t", edits(F.greatest(a, b))).where(F.abs(a - b) <= t)

    def looked_up(i: Column) -> Column:
        start, size = _segment(b, parts, i)
        low, high = F.greatest(-start, -F.floor((t - a + b) / 2).cast("int")), F.least(a - start - size, F.floor((t + a - b) / 2).cast("int"))
        return F.transform(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>")), lambda d: F.xxhash64(b, t, i, F.substring(F.col("input"), start + d + 1, size)))

    x = x.withColumn("_key", F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), parts - 1), looked_up))))).drop("_a", "_b", "_t")
    y = master.where(F.length("candidate") > 0).withColumn("_b", F.length("candidate")).withColumn("_t", F.explode(F.sequence(edits(b), edits(longest(b)))))

    def held(i: Column) -> Column:
        start, size = _segment(b, parts, i)
        return F.xxhash64(b, t, i, F.substring(F.col("candidate"), start + 1, size))

    y = y.withColumn("_key", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), parts - 1), held)))).drop("_b", "_t")
    met = x.join(y, "_key").drop("_key")
    allowed = edits(F.greatest(F.length("input"), F.length("candidate")))
    found = met.withColumn("distance", F.levenshtein("input", "candidate")).where(F.col("distance") <= allowed)
    return found.dropDuplicates(["input", "candidate"])
