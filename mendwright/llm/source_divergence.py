"""Source divergence audit by a baseline-correction inverted index.

How far does each (language, source) group's use of words lie from every other source of its language, and which terms set it
apart from the language as a whole? A term's smoothed share is p = 1 + floor(10^9 * (count + 1) / (N + V)), where V terms
of the language are kept (those in ``least_docs`` of its documents or more) and N sums the group's counts of them; the
divergence of p from q is f = floor((p - q)^2 / q).

The sum of f over all V terms is never taken term by term. With g0, h0 the shares of two groups g, h at count zero:

    sum f(g, h) = V * f(g0, h0)                                                       the baseline
                + sum over the terms of g of f(g, h0) - f(g0, h0)                     one correction per distinct count of g
                + sum over the terms of h of f(g0, h) - f(g0, h0)                     one correction per distinct count of h
                + sum over terms of both of f(g, h) - f(g, h0) - f(g0, h) + f(g0, h0) from the inverted index

so a term's posting list (its groups) gives corrections only to pairs of groups in it. The index holds lists cut into
blocks of sources; lists of one block meet themselves, and where a language has more sources than a block, block meets block by a
join on the term. A task adds up the pairs it has seen and hands on sums, never single corrections. Terms are ranked
by windows behind a limit per group, so a hot group's terms are cut where they are, before the shuffle.

All arithmetic is exact: divisions are done in whole numbers, in steps that can't overflow, and sums of corrections are decimals.

Defined cases: null text, lang and source are ''; a row is a document, so repeated rows count each; a group without kept
terms takes part with counts of zero; a language without kept terms (V = 0) has values 0; a language with one source has no
pairs; an empty table gives no rows; extra columns are ignored. Memory: a task holds the counts of ``MOST_HELD`` terms, then hands them on.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendwright.llm.common import looked_up, written

LEAST_DOCS, MOST_RANKS, SCALE = 3, 200, 1_000_000_000
#: Distinct terms of all groups that a task counts before it hands the counts on; sources in a block of a posting list; pairs worked off side by side.
MOST_HELD, BLOCK, MOST_PAIRS = 400_000, 256, 500_000
#: Up to so many groups are sent to all executors; more are dealt over copies, with the same result.
MOST_SENT = 100_000
#: Bytes of terms stay, A-Z as a-z, all others part them: terms are [^\x00-\x40\x5B-\x60\x7B-\x7F]+, and bytes of other letters are 0x80 and more.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term in each group, added up in this task."""
    count: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}

    def handed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in count.items():
            n = len(terms)
            seen = docs[lang, source]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * n), pa.array([source] * n), pa.array(list(terms), pa.binary()).cast(pa.string()), pa.array(list(terms.values()), pa.int64()), pa.array([seen[t] for t in terms], pa.int64())],
                names=["lang", "source", "term", "n", "docs"],
            )
        count.clear()
        docs.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            if terms := terms_of(text):
                count.setdefault((lang, source), Counter()).update(terms)
                docs.setdefault((lang, source), Counter()).update(set(terms))
        if sum(map(len, count.values())) > MOST_HELD:
            yield from handed_on()
    yield from handed_on()


def _share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 * (count + 1) / total), by long division in three steps of a thousand; count + 1 <= total < 9 * 10^15."""
    total = F.greatest(total, F.lit(1))
    whole = F.when(count + 1 >= total, 1).otherwise(0).cast("long")
    rest = count + 1 - whole * total
    for _ in range(3):
        step = _div(rest * 1000, total)
        whole, rest = whole * 1000 + step, rest * 1000 - step * total
    return whole + 1


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _f(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def _met(facts: DataFrame, groups: DataFrame, n_groups: int, salts: int = 16) -> DataFrame:
    """``facts`` joined with all groups of their language. A language may hold most rows: groups are sent to all executors, or facts are dealt over copies of them."""
    if n_groups <= MOST_SENT:
        return facts.join(F.broadcast(groups), "lang")
    dealt = facts.withColumn("salt", F.pmod(F.xxhash64(*[c for c in facts.columns if c != "lang"]), F.lit(salts)).cast("int"))
    return dealt.join(groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["lang", "salt"]).drop("salt")


def term_counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, source, n, lang_n): the kept terms of each language in the groups that have them, with their counts in group and language."""
    partial = docs.mapInArrow(_partial_counts, "lang string, source string, term string, n long, docs long")
    # dealt by term once: sums by group and by language need no shuffle of their own
    by_group = partial.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = Window.partitionBy("lang", "term")
    return by_group.withColumn("lang_docs", F.sum("docs").over(whole)).withColumn("lang_n", F.sum("n").over(whole)).where(F.col("lang_docs") >= least_docs).select("lang", "term", "source", "n", "lang_n")


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each pair of groups in posting lists that meet, the sum of corrections f(g, h) - f(g, h0) - f(g0, h) + f(g0, h0)."""
    sums: dict[tuple[str, str, str], int] = {}
    f = lambda p, q: (p - q) * (p - q) // q
    for batch in batches:
        left, right = (batch.column(c) for c in ("left", "right"))
        sides = []
        for side in (left, right):
            flat = side.flatten()
            names = flat.field("source").dictionary_encode()
            sides.append((np.diff(np.asarray(side.offsets)), names.indices.to_numpy(), names.dictionary.to_pylist(), flat.field("p").to_numpy(), flat.field("p0").to_numpy()))
        (n_left, code_left, name_left, p_left, p0_left), (n_right, code_right, name_right, p_right, p0_right) = sides
        langs = batch.column("lang").dictionary_encode()
        lang_of, lang_names = langs.indices.to_numpy(), langs.dictionary.to_pylist()
        first_left, first_right = (np.concatenate([[0], np.cumsum(n)]) for n in (n_left, n_right))
        pairs = n_left.astype(np.int64) * n_right
        ends = np.cumsum(pairs)
        marks = np.flatnonzero(np.diff(np.concatenate([[0], (ends - 1).clip(0) // MOST_PAIRS])))
        for a, b in zip([0, *marks], [*marks, len(pairs)], strict=True):
            row = np.repeat(np.arange(a, b), pairs[a:b])
            if not len(row):
                continue
            within = np.arange(len(row)) - np.repeat(np.cumsum(pairs[a:b]) - pairs[a:b], pairs[a:b])
            i, j = first_left[row] + within // n_right[row], first_right[row] + within % n_right[row]
            p, p0, q, q0 = p_left[i], p0_left[i], p_right[j], p0_right[j]
            change = f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)
            code = (lang_of[row].astype(np.int64) * len(name_left) + code_left[i]) * len(name_right) + code_right[j]
            order = np.argsort(code, kind="stable")
            code, change = code[order], change[order]
            at = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            # halves, so that no sum overflows
            for c, high, low in zip(code[at].tolist(), np.add.reduceat(change >> 32, at).tolist(), np.add.reduceat(change & 0xFFFFFFFF, at).tolist(), strict=True):
                rest, h = divmod(c, len(name_right))
                k, g = divmod(rest, len(name_left))
                if name_left[g] != name_right[h]:
                    key = lang_names[k], name_left[g], name_right[h]
                    sums[key] = sums.get(key, 0) + (high << 32) + low
        if len(sums) > MOST_HELD:
            yield _sums(sums)
            sums = {}
    yield _sums(sums)


def _sums(sums: dict[tuple[str, str, str], int]) -> pa.RecordBatch:
    lang, source, item = ([k[i] for k in sums] for i in range(3))
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(item, pa.string()), pa.array([str(v) for v in sums.values()], pa.string())], names=["lang", "source", "item", "change"])


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): for each group the divergence from every other source of its language
    (``pair``) and the terms that it uses more than the language does, by divergence (``term``, the first 200)."""
    own = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    kept = written(term_counts(own))
    terms = kept.groupBy("lang").agg(F.countDistinct("term").alias("v"), F.sum("n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = own.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(terms, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("v", F.lit(0)).cast("long").alias("v"), (F.coalesce("total", F.lit(0)) + F.coalesce("v", F.lit(0))).cast("long").alias("d"), (F.col("lang_total") + F.col("v")).cast("long").alias("lang_d"))
    groups = written(groups.withColumn("p0", F.when(F.col("v") > 0, _share(F.lit(0).cast("long"), F.col("d"))).otherwise(1)))
    n_groups = groups.count()
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0  # sources of a language

    shares = looked_up(kept, groups.select("lang", "source", "d", "lang_d", "p0"), ["lang", "source"])
    shares = written(shares.select("lang", "term", "source", _share(F.col("n"), F.col("d")).alias("p"), "p0", _share(F.col("lang_n"), F.col("lang_d")).alias("lang_p")))

    ranked = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    term = shares.where("p > lang_p").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f(F.col("p"), F.col("lang_p")).alias("value"))
    term = term.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= MOST_RANKS)

    exact = "decimal(38,0)"
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    p, p0, q0 = F.col("p"), F.col("p0"), F.col("q0")
    base = _met(groups.select("lang", "source", "v", "p0"), other, n_groups).where("source != item").select("lang", "source", "item", (F.col("v").cast("decimal(20,0)") * _f(p0, q0)).cast(exact).alias("change"))
    counted = shares.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("terms"))
    times = F.col("terms").cast("decimal(18,0)")
    single = _met(counted, other, n_groups).where("source != item").select("lang", F.inline(F.array(
        F.struct("source", "item", (times * (_f(p, q0) - _f(p0, q0))).cast(exact).alias("change")),
        F.struct(F.col("item").alias("source"), F.col("source").alias("item"), (times * (_f(q0, p) - _f(q0, p0))).cast(exact).alias("change")),
    )))
    posting = F.struct("source", "p", "p0")
    if most <= block:
        met = shares.groupBy("lang", "term").agg(F.collect_list(posting).alias("left")).select("lang", "left", F.col("left").alias("right"))
    else:
        cut = F.pmod(F.xxhash64("source"), F.lit(-(-most // block))).alias("cut")
        lists = written(shares.groupBy("lang", "term", cut).agg(F.collect_list(posting).alias("left")).drop("cut"))
        met = lists.join(lists.withColumnRenamed("left", "right"), ["lang", "term"]).select("lang", "left", "right")
    both = met.mapInArrow(_pair_sums, "lang string, source string, item string, change string").withColumn("change", F.col("change").cast(exact))
    pair = base.unionByName(single).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("change").cast("long").alias("value"))
    pair = pair.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(ranked))
    return pair.unionByName(term).select("lang", "source", "part", "item", "value", "rank")


#: The same from DuckDB, term by term and pair by pair.
ORACLE_SQL = r"""
with docs as (
  select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
words as (
  select id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}]+')) as term from docs),
kept as (select lang, term, count(*) as lang_n from words group by lang, term having count(distinct id) >= 3),
groups as (select distinct lang, source from docs),
counts as (select lang, source, term, count(*) as n from words group by all),
grid as (
  select g.lang, g.source, k.term, k.lang_n, coalesce(c.n, 0)::hugeint as n
  from groups g join kept k using (lang) left join counts c using (lang, source, term)),
shares as (
  select *, 1 + (1000000000::hugeint * (n + 1)) // (sum(n) over (partition by lang, source) + count(*) over (partition by lang, source)) as p,
    1 + (1000000000::hugeint * (lang_n + 1)) // (sum(n) over (partition by lang) + count(*) over (partition by lang, source)) as lang_p
  from grid),
pairs as (
  select g.lang, g.source, h.source as item, coalesce(sum(((a.p - b.p) * (a.p - b.p)) // b.p), 0)::bigint as value
  from groups g join groups h on g.lang = h.lang and g.source <> h.source
  left join shares a on a.lang = g.lang and a.source = g.source left join shares b on b.lang = h.lang and b.source = h.source and b.term = a.term
  where a.term is null or b.term is not null group by all),
found as (
  select lang, source, 'pair' as part, item, value from pairs
  union all select lang, source, 'term', term, (((p - lang_p) * (p - lang_p)) // lang_p)::bigint from shares where n > 0 and p > lang_p),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from found)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 200
"""
