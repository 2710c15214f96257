"""Document fingerprints: invertible Bloom lookup sketches of paragraphs, by DataFrame functions alone.

A text's paragraphs are its lines; a line of more than 240 characters counts as several (each goes on to the
end of its last word). The set of their digests (40 bits, with a check of 16) is added to a table of three
parts with 21 cells each: a digest goes to one cell of each part, where counts add up and digests are xored.
The table, with the number of digests, is the fingerprint. Two fingerprints subtract cell by cell; what the
texts share cancels, and peeling takes cells that hold a single digest, removes it from its other cells and
goes on until nothing is left. If something is left, the comparison is retried larger: the digests are dealt
to as many tables as their number needs, each peeled on its own; a table that fails even so is compared
exactly. Likeness is shared over all distinct digests of both texts (1 for two texts without any).

``next`` is the row after in ascending doc_id (nulls first, ties by text), the first row after the last. Rows
are dealt once, by ranges of doc_id cut at sampled quantiles; the row that begins a range also goes to the
range before it, so no range needs to see another.

Defined cases: null and empty texts have the fingerprint of no paragraphs; equal texts have equal fingerprints;
a single row is its own next; repeated ids stand in order of their texts, in one range; ids may be numbers, texts or
dates; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from mendwright.llm.common import texts_of

PARAGRAPH = r"[^\n]{1,240}[^\n\s]*"
CELLS = 21
#: Digests of both texts for each table of a retry, and the cells of each of its three parts.
SHARE, SHARE_CELLS = 12, 16
ROUNDS = 14
LOW40, LOW56 = (1 << 40) - 1, (1 << 56) - 1


def _check(digest: Column) -> Column:
    return F.shiftleft(F.xxhash64(digest).bitwiseAND(F.lit(0xFFFF).cast("long")), 40)


def digests(text: Column) -> Column:
    """Distinct (digest, check) values of the text's paragraphs."""

    def one(piece: Column) -> Column:
        low = F.xxhash64(piece).bitwiseAND(F.lit(LOW40).cast("long"))
        return low.bitwiseOR(_check(low))

    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), one))


def _cell(key: Column, part: int, cells: int, shift: int = 0) -> Column:
    """The cell of a key in one part of a table, as a number over all parts."""
    bits = F.shiftrightunsigned(key, 13 * part + shift).bitwiseAND(F.lit(0x1FFF).cast("long"))
    return (bits % cells + part * cells).cast("int")


def _hits(key: Column, cell: Column, cells: int) -> Column:
    return (cell == _cell(key, 0, cells)) | (cell == _cell(key, 1, cells)) | (cell == _cell(key, 2, cells))


def table(keys: Column, cells: int) -> Column:
    """Cells (x: xor of the keys, n: their number) of a set of keys."""
    groups = F.transform(F.sequence(F.lit(0), F.lit(3 * cells - 1)), lambda c: F.filter(keys, lambda k: _hits(k, c, cells)))
    return F.transform(groups, lambda g: F.struct(F.aggregate(g, F.lit(0).cast("long"), lambda a, k: a.bitwiseXOR(k)).alias("x"), F.size(g).alias("n")))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: F.struct(p["x"].bitwiseXOR(q["x"]).alias("x"), (p["n"] - q["n"]).alias("n")))


def peel(cells: Column, size: int) -> Column:
    """(cells that are left, found: the differing keys with 1 or -1) after peeling a difference of tables."""

    def single(s: Column, i: Column) -> Column:
        low = s["x"].bitwiseAND(F.lit(LOW40).cast("long"))
        return (F.abs(s["n"]) == 1) & (s["x"] == low.bitwiseOR(_check(low))) & _hits(s["x"], i, size)

    def one_round(state: Column, _: Column) -> Column:
        pure = F.array_distinct(F.filter(state["cells"], single))

        def without(pure: Column) -> Column:
            rest = F.transform(
                state["cells"],
                lambda s, i: F.aggregate(F.filter(pure, lambda p: _hits(p["x"], i, size)), s, lambda a, p: F.struct(a["x"].bitwiseXOR(p["x"]).alias("x"), (a["n"] - p["n"]).alias("n"))),
            )
            return F.struct(rest.alias("cells"), F.concat(state["found"], pure).alias("found"))

        # a lambda over an array of one: pure is worked out once
        return F.when(F.size(F.filter(state["cells"], single)) > 0, F.element_at(F.transform(F.array(pure), without), 1)).otherwise(state)

    start = F.struct(cells.alias("cells"), F.slice(cells, 1, 0).alias("found"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, one_round)


def emptied(state: Column) -> Column:
    """Has peeling come to an end with nothing left? Only then are the found keys the whole difference."""
    return F.forall(state["cells"], lambda s: (s["x"] == 0) & (s["n"] == 0))


def alone_in(found: Column) -> Column:
    """The number of keys found with 1; a sum of keys that was taken for one and taken back later doesn't count."""
    return F.size(F.filter(found, lambda f: (f["n"] == 1) & ~F.exists(found, lambda g: (g["x"] == f["x"]) & (g["n"] == -1))))


def _retried(a: Column, b: Column) -> Column:
    """The number of keys in ``a`` alone, with tables as many as both sets need, by two steps of dealing."""
    tables = F.ceil((F.size(a) + F.size(b)) / F.lit(float(SHARE))).cast("int")
    outer = F.greatest(F.ceil(F.sqrt(tables.cast("double"))).cast("int"), F.lit(1))

    def place(k: Column, seed: int) -> Column:
        return F.pmod(F.xxhash64(k, F.lit(seed)), outer.cast("long")).cast("int")

    numbers = F.sequence(F.lit(0), outer - 1)
    coarse = F.transform(numbers, lambda s: F.struct(F.filter(a, lambda k: place(k, 1) == s).alias("a"), F.filter(b, lambda k: place(k, 1) == s).alias("b")))
    fine = F.flatten(F.transform(coarse, lambda g: F.transform(numbers, lambda s: F.struct(F.filter(g["a"], lambda k: place(k, 2) == s).alias("a"), F.filter(g["b"], lambda k: place(k, 2) == s).alias("b")))))

    def alone(g: Column) -> Column:
        state = peel(subtract(table(g["a"], SHARE_CELLS), table(g["b"], SHARE_CELLS)), SHARE_CELLS)
        return F.element_at(F.transform(F.array(state), lambda st: F.when(emptied(st), alone_in(st["found"])).otherwise(F.size(F.array_except(g["a"], g["b"])))), 1)

    return F.aggregate(F.transform(F.filter(fine, lambda g: F.size(g["a"]) + F.size(g["b"]) > 0), alone), F.lit(0), lambda s, x: s + x)


def fingerprint(keys: Column, cells: Column) -> Column:
    """The sketch as text: the number of digests and the cells, in base 64."""
    body = F.array_join(F.transform(cells, lambda s: F.concat(F.lpad(F.hex(s["n"].cast("long") % 256), 2, "0"), F.lpad(F.hex(s["x"]), 14, "0"))), "")
    return F.base64(F.unhex(F.concat(F.lpad(F.hex(F.size(keys).cast("long")), 8, "0"), body)))


def _likeness(name: str, other: str, df: DataFrame) -> DataFrame:
    """Adds ``name``: likeness of keys/cells to those of ``other``."""
    a, b = F.col("keys"), F.col(f"{other}_keys")
    df = df.withColumn("peeled", peel(subtract(F.col("cells"), F.col(f"{other}_cells")), CELLS))
    alone = F.when(emptied(F.col("peeled")), alone_in(F.col("peeled")["found"])).otherwise(_retried(a, b))
    likeness = F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise((F.size(a) - F.col("alone")) / F.greatest(F.size(b) + F.col("alone"), F.lit(1)))
    return df.withColumn("alone", alone).withColumn(name, likeness).drop("peeled", "alone")


def _edges(ids: DataFrame, buckets: int) -> list:
    """Ascending values of doc_id that cut its rows into about so many ranges; at most one edge for each range comes to the driver."""
    if not isinstance(ids.schema["doc_id"].dataType, NumericType):
        dealt = ids.where("doc_id is not null").repartitionByRange(buckets, "doc_id")
        return sorted(r[0] for r in dealt.groupBy(F.spark_partition_id()).agg(F.min("doc_id")).select("min(doc_id)").collect())
    shares = [k / buckets for k in range(1, buckets)]
    return sorted(set(ids.agg(F.percentile_approx("doc_id", shares, max(10_000, 20 * buckets))).first()[0] or []))


def with_next(docs: DataFrame, bucket_rows: int = 2000, most_buckets: int = 1 << 18) -> DataFrame:
    """Each row (doc_id, text, keys) with next_text and next_keys, and its ``bucket``, by which the result is partitioned.

    doc_id may be of any type that has an order and a text form. Beyond ``most_buckets`` ranges these get longer; their sort spills.
    """
    ids = docs.select("doc_id")
    kind = ids.schema["doc_id"].dataType.simpleString()
    row = ids.agg(F.min("doc_id").alias("first"), F.count_if(F.col("doc_id").isNull()).alias("nulls"), F.count("*").alias("n")).first()
    buckets = max(1, min(most_buckets, row["n"] // bucket_rows))
    first = None if row["nulls"] else row["first"]
    cuts = [c for c in _edges(ids, buckets) if c > row["first"]] if buckets > 1 else []
    mark = "\x1f"  # parts the edges; no value may hold it
    while any(mark in str(c) for c in cuts):
        mark += "\x1e"

    def values(some: list) -> Column:
        return F.split(F.lit(mark.join(map(str, some))), mark).cast(f"array<{kind}>") if some else F.array().cast(f"array<{kind}>")

    edges = values(cuts)
    # two steps find the range: first among every side-th edge, then between two of these
    side = max(1, round(len(cuts) ** 0.5))
    coarse = values(cuts[::side])
    block = F.size(F.filter(coarse, lambda e: e <= F.col("doc_id")))
    within = F.slice(edges, F.greatest(block - 1, F.lit(0)) * side + 1, side)
    bucket = F.when(F.col("doc_id").isNull() | (block == 0), 0).otherwise((block - 1) * side + F.size(F.filter(within, lambda e: e <= F.col("doc_id"))))
    begins = F.coalesce((F.col("b") > 0) & (F.element_at(edges, F.greatest(F.col("b"), F.lit(1))) == F.col("doc_id")), F.lit(False)) if cuts else F.lit(False)
    is_first = F.col("doc_id").isNull() if first is None else F.col("doc_id") == first
    copies = F.array_compact(F.array(
        F.struct(F.col("b").alias("bucket"), F.lit(0).alias("guard")),
        F.when(begins, F.struct((F.col("b") - 1).alias("bucket"), F.lit(1).alias("guard"))),
        F.when(is_first, F.struct(F.lit(len(cuts)).alias("bucket"), F.lit(2).alias("guard"))),
    ))
    dealt = docs.withColumn("b", bucket).withColumn("copy", F.explode(copies)).select("doc_id", "text", "keys", "copy.bucket", "copy.guard")
    order = Window.partitionBy("bucket").orderBy("guard", F.col("doc_id").asc_nulls_first(), "text")
    return dealt.withColumn("next", F.lead(F.struct("text", "keys")).over(order)).where("guard = 0").select("doc_id", "text", "keys", F.col("next.text").alias("next_text"), F.col("next.keys").alias("next_keys"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and likeness to that and to the next document."""
    own = texts_of(docs, id_col, text_col).withColumn("keys", digests(F.col("text")))
    half = F.floor(F.length("text") / 2).cast("int")
    df = with_next(own).withColumn("n_chars", F.length("text").cast("long"))
    df = df.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half)))
    df = df.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).withColumn("edited_keys", digests(F.col("edited")))
    df = df.drop("text", "next_text", "edited")
    df = df.withColumn("cells", table(F.col("keys"), CELLS)).withColumn("edited_cells", table(F.col("edited_keys"), CELLS)).withColumn("next_cells", table(F.col("next_keys"), CELLS))
    df = df.withColumn("fingerprint", fingerprint(F.col("keys"), F.col("cells"))).withColumn("edited_fingerprint", fingerprint(F.col("edited_keys"), F.col("edited_cells")))
    df = _likeness("near_next", "next", _likeness("near_edited", "edited", df))
    return df.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
