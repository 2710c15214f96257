"""Synthetic faults and training sets. Randomness is a hash of key and salt, so it doesn't depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Letters and digits that are misread for one another, and keyboard neighbours.
MISREAD = {"o": "0", "0": "o", "i": "1", "1": "i", "l": "1", "s": "5", "5": "s", "b": "6", "6": "b", "g": "9", "O": "0", "I": "1", "S": "5", "B": "8"}
NEIGHBOURS = {
    "q": "wa", "w": "qes", "e": "wrd", "r": "etf", "t": "ryg", "y": "tuh", "u": "yij", "i": "uok", "o": "ipl", "p": "ol", "a": "qsz", "s": "adwx", "d": "sfec",
    "f": "dgrv", "g": "fhtb", "h": "gjyn", "j": "hkum", "k": "jli", "l": "kop", "z": "ax", "x": "zcs", "c": "xvd", "v": "cbf", "b": "vng", "n": "bmh", "m": "nj",
}
KINDS = ("substitute", "delete", "insert", "transpose", "misread", "neighbour")
ALPHABET = "abcdefghijklmnopqrstuvwxyz"


def pick(key: Column, salt: str, n: Column | int) -> Column:
    """A number below n from md5(key, salt): the same on every engine."""
    h = F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit("|"), F.lit(salt)).cast("binary")), 1, 8), 16, 10).cast("bigint")
    return (h % (F.lit(n) if isinstance(n, int) else n)).cast("int")


def faulty(text: Column, key: Column, kind: Column, salt: str = "typo") -> Column:
    """``text``, lower-cased, with one fault of the kind; texts shorter than two characters stay as they are."""
    low = F.lower(text)
    n = F.length(low)
    at = pick(key, f"{salt}-at", F.greatest(n, F.lit(1))) + 1
    two = pick(key, f"{salt}-two", F.greatest(n - 1, F.lit(1))) + 1
    gap = pick(key, f"{salt}-gap", n + 1) + 1
    letter = F.substring(F.lit(ALPHABET), pick(key, f"{salt}-letter", 26) + 1, F.lit(1))
    head, char, tail = F.substring(low, F.lit(1), at - 1), F.substring(low, at, F.lit(1)), F.substring(low, at + 1, n)
    swapped = F.concat(F.substring(low, F.lit(1), two - 1), F.substring(low, two + 1, F.lit(1)), F.substring(low, two, F.lit(1)), F.substring(low, two + 2, n))
    beside = F.try_element_at(F.create_map(*[F.lit(x) for p in NEIGHBOURS.items() for x in p]), char)
    neighbour = F.coalesce(F.substring(beside, pick(key, f"{salt}-near", F.greatest(F.length(beside), F.lit(1))) + 1, F.lit(1)), char)
    misread = F.translate(char, "".join(MISREAD), "".join(MISREAD.values()))
    done = F.when(kind == "substitute", F.concat(head, letter, tail)).when(kind == "delete", F.concat(head, tail)).when(kind == "transpose", swapped)
    done = done.when(kind == "insert", F.concat(F.substring(low, F.lit(1), gap - 1), letter, F.substring(low, gap, n)))
    done = done.when(kind == "misread", F.concat(head, misread, tail)).otherwise(F.concat(head, neighbour, tail))
    return F.when(n < 2, text).otherwise(done)


def several_faults(df: DataFrame, text: str, key: str, n: Column, most: int, salt: str = "typo") -> DataFrame:
    """``df`` with ``n`` faults, at most ``most``, of kinds by chance in its column ``text``, one after another."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    for k in range(most):
        kind = F.element_at(kinds, pick(F.col(key), f"{salt}-kind-{k}", len(KINDS)) + 1)
        df = df.withColumn(text, F.when(n > k, faulty(F.col(text), F.col(key), kind, f"{salt}-{k}")).otherwise(F.col(text)))
    return df


def dataset(values: DataFrame, n: int, salt: str = "set") -> DataFrame:
    """(row_id, input_text, correct_text, field_type, correction_type, n_faults): n rows, a third of each field type, with one or two
    faults each (one to three in combined values). values: (field_type, value, position), a bounded master."""
    counts = {r["field_type"]: r["n"] for r in values.groupBy("field_type").agg(F.count("*").alias("n")).collect()}
    parts = []
    for f, there in sorted(counts.items()):
        most = 3 if f == "combined" else 2
        ids = values.sparkSession.range(n // len(counts)).select(F.concat(F.lit(f), F.lit("-"), F.col("id").cast("string")).alias("row_id"))
        own = values.where(F.col("field_type") == f).select("value", "position", "field_type")
        chosen = ids.withColumn("position", pick(F.col("row_id"), salt, there) + 1).join(own, "position")
        chosen = chosen.withColumns({"n_faults": pick(F.col("row_id"), f"{salt}-n", most) + 1, "input_text": F.col("value")})
        made = several_faults(chosen, "input_text", "row_id", F.col("n_faults"), most, salt)
        parts.append(made.select("row_id", "input_text", F.col("value").alias("correct_text"), "field_type", F.lit("synthetic").alias("correction_type"), "n_faults"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def faults_of_each(values: DataFrame) -> DataFrame:
    """(row_id, input_text, correct_text, n_faults): each distinct value (value) with every kind of fault, six times alone and once before every
    kind as a second one, so 72 rows a value, however many there are. Where faults strike hangs on the value alone; null values have no rows."""
    every = F.array(*[F.struct(F.lit(n).alias("n_faults"), F.lit(a).alias("first"), F.lit(b).alias("second")) for n in (1, 2) for a in KINDS for b in KINDS])
    rows = values.select("value").where("value is not null").distinct().select("value", F.inline(every)).withColumn("row_id", F.concat_ws("|", "value", "n_faults", "first", "second"))
    rows = rows.withColumn("input_text", faulty(F.col("value"), F.col("row_id"), F.col("first"), "each-0"))
    rows = rows.withColumn("input_text", F.when(F.col("n_faults") == 2, faulty(F.col("input_text"), F.col("row_id"), F.col("second"), "each-1")).otherwise(F.col("input_text")))
    return rows.select("row_id", "input_text", F.col("value").alias("correct_text"), "n_faults")


def label_index(labels: DataFrame) -> DataFrame:
    """(label, index): labels (label, position) numbered from 0; a label that stands twice has its last number."""
    return labels.groupBy("label").agg((F.max("position") - 1).alias("index"))


def split(df: DataFrame, key: str, label: str, share: float = 0.8, salt: str = "42") -> DataFrame:
    """Adds ``part`` (train or test): in each label, rows in order of a hash, the first ``share`` to train."""
    order = Window.partitionBy(label).orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(salt)).cast("binary")), key)
    n = F.count("*").over(Window.partitionBy(label))
    return df.withColumn("part", F.when(F.row_number().over(order) <= F.ceil(n * share), "train").otherwise("test"))
