"""N-gram Jaccard join by vertical partitioning, and the classes it makes.

A text's set is its distinct ``size``-word shingles as 64-bit hashes; two texts link when the sets' Jaccard
similarity is at least ``percent`` / 100. Steps:

1. Equal sets fall together to one node (a hash of the set), before anything is compared.
2. Global order: every shingle's number of nodes is counted exactly. Nodes are dealt to chunks; a chunk sends its
   distinct shingles as packed sorted keys to buckets of the key space, and gets their counts back in order.
   Rare shingles come first in the order, ties by hash.
3. A pair at the limit shares one of the first n - ceil(percent * n / 100) + 1 shingles of each. Those that occur
   in one node alone can't be shared, so a node keeps its other ones as postings; nodes without are done.
4. Candidates, without all pairs of a group: in rounds, each node is held against a few other nodes of its
   posting groups, and linked nodes become one component. Groups inside one component need no more. What then
   still stands in different components within a group is compared behind exact filters. Nodes meet by key and
   size band; the key must be the first that the two share, so its place in either set bounds the overlap (with
   sets of one size it lies among the first ninth, so texts that share a passage and have a ninth of their own
   don't meet at all); differing parity bits of the sets never exceed the differing shingles.
5. Vertical partitioning: a node's set is cut into fragments of the global order, at fixed frequencies. For each
   candidate pair the overlaps of fragments are counted apart and summed per pair, which decides the link. What
   occurs in one node alone is in no overlap: it is counted in the set's size and stands in no fragment.

No link between different sets that could join two components is lost. Where links are asked for, every pair of sets inside a component is
verified as well, block by block, and counted for each document: links lie inside components, so none is missed. Pairs aren't listed.

Defined cases: texts without words (and null texts) have an empty set and link with nothing; texts of fewer
words than ``size`` have one shingle, the whole sequence; rows of one id count as one document's rows (the
smallest id names a component); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendwright.llm.common import blocks, byte_words, chunks_for, texts_of, trim, written
from mendwright.llm.packed import filled, pack, pack_counts, unpack, unpack_counts

PARITY_WORDS, KEY_BITS = 8, 48
#: The frequencies at which the fragments of the global order begin.
PIVOTS = np.array([2, 4, 16, 256])
#: Chunks for each bucket of the key space: messages go from chunks to the buckets that they have keys of, and a bucket's keys must fit in a task.
CHUNKS_A_BUCKET = 2
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]
_HASHES: dict[bytes, int] = {}


def _hashes(words: list[bytes]) -> np.ndarray:
    try:
        return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    except KeyError:
        if len(_HASHES) > 120_000:
            _HASHES.clear()
        for w in words:
            if w not in _HASHES:
                _HASHES[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def shingle_sets(texts: list[str], size: int = 5) -> Iterator[np.ndarray]:
    """The set of each text, as ascending distinct 64-bit values."""
    for text in texts:
        h = _hashes(byte_words(text))
        k = min(size, len(h))
        if not k:
            yield np.zeros(0, np.uint64)
            continue
        m = len(h) - k + 1
        v = np.full(m, k, np.uint64)
        for j in range(k):
            v ^= h[j : j + m]
            v *= _MIX[j % 5]
            v ^= v >> np.uint64(29)
        v.sort()
        yield v[np.append(True, v[1:] != v[:-1])] if m > 1 else v


def _node(s: np.ndarray) -> int:
    """A signed 64-bit name of the set."""
    return xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s) & 0xFFFF) - (1 << 63)


def set_table(docs: DataFrame, size: int = 5) -> DataFrame:
    """(doc_id, row, size, n, node) of each row; row is a hash of id and text, size the text's bytes, node is null for an empty set."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in blocks(frames):
            n, node = [], []
            for s in shingle_sets(frame["text"].tolist(), size):
                n.append(len(s))
                node.append(_node(s) if len(s) else None)
            yield pd.DataFrame({"doc_id": frame["doc_id"].to_numpy(), "row": frame["row"].to_numpy(), "size": frame["size"].to_numpy(), "n": n, "node": pd.array(node, dtype="Int64")})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.withColumns({"row": F.xxhash64("doc_id", "text"), "size": F.octet_length("text")}).mapInPandas(work, f"doc_id {kind}, row long, size long, n long, node long")


def _parity(s: np.ndarray) -> list[int]:
    """Bits that tell whether an odd number of shingles hashes to each of the places."""
    bits = np.bincount((s >> np.uint64(7)).astype(np.int64) % (64 * PARITY_WORDS), minlength=64 * PARITY_WORDS).astype(np.uint8) & 1
    return np.packbits(bits).view(np.int64).tolist()


def _fragments(s: np.ndarray, df: np.ndarray) -> list[bytes]:
    """The shingles that others have too, by their frequencies. A shingle has one frequency, so it falls into the same fragment of every set."""
    part = np.searchsorted(PIVOTS, df, "right")
    return [pack(s[part == k]) for k in range(1, len(PIVOTS) + 1)]


def kept_nodes(docs: DataFrame, nodes: DataFrame, chunks: int, size: int, percent: int) -> DataFrame:
    """(node, n, keys, places, segments, parity): nodes that share a shingle of their prefix with others. nodes: (node, row), one row's hash for each node."""
    buckets = max(8, -(-chunks // CHUNKS_A_BUCKET))
    dealt = docs.select("text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"))
    reps = nodes.select("node", F.pmod("row", F.lit(chunks)).cast("int").alias("chunk"))

    def own_sets(frame: pd.DataFrame, wanted: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(node, set) of the chunk's nodes, each once, by node."""
        left, out = set(wanted.tolist()), []
        for s in shingle_sets(frame["text"].tolist(), size):
            if len(s) and (x := _node(s)) in left:
                left.remove(x)
                out.append((x, s))
        return sorted(out, key=lambda p: p[0])

    def distinct_keys(sets: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        every = np.concatenate([s for _, s in sets]) >> np.uint64(64 - KEY_BITS) if sets else np.zeros(0, np.uint64)
        return np.unique(every, return_inverse=True, return_counts=True)

    def ask(frame: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        columns = ["chunk", "bucket", "keys", "counts"]
        if not len(wanted) or not len(frame):
            return pd.DataFrame(columns=columns)
        keys, _, counts = distinct_keys(own_sets(frame, wanted["node"].to_numpy()))
        trim()
        number = int(frame["chunk"].iloc[0])
        return pd.DataFrame([(number, b, pack(keys[i:j]), pack_counts(counts[i:j])) for b, i, j in filled(keys, KEY_BITS, buckets)], columns=columns)

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        keys = [unpack(x) for x in frame["keys"]]
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(place, weights=np.concatenate([unpack_counts(x) for x in frame["counts"]]), minlength=len(distinct)).astype(np.int64)
        parts = np.split(totals[place], np.cumsum([len(k) for k in keys])[:-1])
        del keys, distinct, place
        trim()
        return pd.DataFrame({"chunk": frame["chunk"].to_numpy(), "bucket": frame["bucket"].to_numpy(), "totals": [pack_counts(p) for p in parts], "node": np.zeros(len(frame), np.int64)})  # no nulls: pandas would make floats of them

    def choose(frame: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        trim()
        columns = ["node", "n", "keys", "places", "segments", *(f"p{k}" for k in range(PARITY_WORDS))]
        wanted = told[told["bucket"] < 0]
        if not len(wanted) or not len(frame):
            return pd.DataFrame(columns=columns)
        sets = own_sets(frame, wanted["node"].to_numpy())
        keys, place, _ = distinct_keys(sets)
        df = np.concatenate([unpack_counts(x) for x in told[told["bucket"] >= 0].sort_values("bucket")["totals"]])[place]
        rows, at = [], 0
        for node, s in sets:
            n = len(s)
            own = df[at : at + n]
            at += n
            first = np.lexsort((s, own))[: n - (-(-percent * n // 100)) + 1]
            places = np.flatnonzero(own[first] > 1)
            if len(places):
                rows.append((node, n, s[first[places]].view(np.int64).tolist(), places.tolist(), _fragments(s, own), *_parity(s)))
        return pd.DataFrame(rows, columns=columns)

    sent = dealt.groupBy("chunk").cogroup(reps.groupBy("chunk")).applyInPandas(ask, "chunk int, bucket int, keys binary, counts binary")
    told = sent.groupBy("bucket").applyInPandas(add, "chunk int, bucket int, totals binary, node long")
    told = told.unionByName(reps.select("chunk", F.lit(-1).alias("bucket"), F.lit(None).cast("binary").alias("totals"), "node"))
    schema = "node long, n long, keys array<long>, places array<long>, segments array<binary>, " + ", ".join(f"p{k} long" for k in range(PARITY_WORDS))
    return dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(choose, schema)


def _overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([len(np.intersect1d(unpack(x), unpack(y), assume_unique=True)) for x, y in zip(a, b, strict=True)], dtype="int64")


def links(pairs: DataFrame, kept: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` that link: overlaps per fragment, summed per pair."""
    side = kept.select("node", "n", "segments")
    overlap = F.pandas_udf(_overlap, "long")
    both = pairs.join(side.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("segments").alias("sb")), "b").join(side.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("segments").alias("sa")), "a")
    parts = both.select("a", "b", "na", "nb", F.explode(F.arrays_zip("sa", "sb")).alias("s")).select("a", "b", "na", "nb", overlap("s.sa", "s.sb").alias("o"))
    summed = parts.groupBy("a", "b").agg(F.sum("o").alias("o"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return summed.where(100 * F.col("o") >= percent * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): comp is the smallest node reachable; by alternating large and small stars until nothing changes."""
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    mark = F.struct(F.count("*"), F.bit_xor(F.xxhash64("u", "v")))
    state = e.agg(mark).first()[0]
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("u", "v", "m")
        e = written(small.select("u", F.col("m").alias("v")).unionByName(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        now = e.agg(mark).first()[0]
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp"))


def _near_in_size(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _with_comp(df: DataFrame, comps: DataFrame | None, node: str = "node", comp: str = "comp") -> DataFrame:
    if comps is None:
        return df.withColumn(comp, F.col(node))
    return df.join(comps.select(F.col("node").alias(node), F.col("comp").alias(comp)), node, "left").withColumn(comp, F.coalesce(comp, node))


def _could_link(x: str, y: str, percent: int) -> Column:
    """If this is the first shingle that the sets share in the global order, may they link? Both ends of it count:
    sizes, and what either set has from this place on."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    rest = F.least(n - F.col(f"{x}.place"), m - F.col(f"{y}.place"))
    return _near_in_size(n, m, percent) & ((100 + percent) * rest >= percent * (n + m))


def postings(kept: DataFrame) -> DataFrame:
    """(key, place, before, node, n) of the shared shingles of the prefixes; before is the key that precedes in the node's prefix."""
    before = F.concat(F.array(F.lit(None).cast("long")), "keys")
    posts = kept.select("node", "n", F.explode(F.arrays_zip("keys", "places", before.alias("before"))).alias("p")).select(F.col("p.keys").alias("key"), F.col("p.places").alias("place"), "p.before", "node", "n").where("key is not null")
    # keys with the same nodes say the same: the first of them in the order is enough, it has the least places
    group = posts.groupBy("key").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), F.sum("place").alias("places")).where("c > 1")
    return posts.join(group.groupBy("c", "x", "y").agg(F.min_by("key", "places").alias("key")).select("key"), "key", "left_semi")


def candidates(left: DataFrame, percent: int) -> DataFrame:
    """(a, b, d): pairs of nodes in different components whose first shared key could make them link; d: differing parity bits.

    left: postings with comp and parity. Nodes meet by key and band of sizes. The smaller set of a pair must have the
    first shared key among its first n - o + 1, with o the overlap that two sets of its size need: few postings can be
    the smaller side. A key whose predecessor is the same in both is not the first one.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(101.0 / percent)))  # the 1 lets rounding errors pass
    x = left.where((100 + percent) * (F.col("n") - F.col("place")) >= 2 * percent * F.col("n")).withColumn("band", band).alias("x")
    y = left.withColumn("band", F.explode(F.array(band, band - 1))).alias("y")
    differing = sum((F.bit_count(F.col(f"x.p{k}").bitwiseXOR(F.col(f"y.p{k}"))) for k in range(PARITY_WORDS)), F.lit(0))
    # |A - B| + |B - A| <= (|A| + |B|) * (1 - t) / (1 + t)
    near = differing * (100 + percent) <= (F.col("x.n") + F.col("y.n")) * (100 - percent)
    smaller = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.node") < F.col("y.node")))
    first = F.coalesce(F.col("x.before") != F.col("y.before"), F.lit(True))
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.band") == F.col("y.band")) & smaller & (F.col("x.comp") != F.col("y.comp")) & first & _could_link("x", "y", percent) & near)
    return met.groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(F.min(differing).alias("d"))


def node_components(kept: DataFrame, percent: int, rounds: int = 2, centers: int = 4) -> DataFrame:
    """(node, comp) of the nodes that link with another."""
    posts = written(postings(kept))
    comps = None

    def joined_by(new: DataFrame) -> DataFrame:
        return components(new if comps is None else comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(new))

    # rounds: a node is held against a few other ones, which stand for its groups in other components
    for r in range(rounds):
        own = _with_comp(posts, comps).alias("own")
        turns = [F.xxhash64("node", F.lit(r * centers + j)) for j in range(centers)]
        center = own.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), *[F.min_by(F.struct("node", "n", "comp", "place"), t).alias(f"c{j}") for j, t in enumerate(turns)])
        met = own.join(center.where("low != high").drop("low", "high"), "key")
        picks = []
        for j in range(centers):
            other = F.col(f"c{j}.node")
            ok = (F.col("own.comp") != F.col(f"c{j}.comp")) & _could_link("own", f"c{j}", percent)
            picks.append(F.min_by(F.when(ok, other), F.when(ok, F.xxhash64(other, F.lit(r * centers + j)))))
        pairs = met.groupBy(F.col("own.node").alias("b")).agg(F.array_distinct(F.array_compact(F.array(*picks))).alias("a")).select(F.explode("a").alias("a"), "b")
        comps = joined_by(links(pairs, kept, percent))
    # what is left between components, behind exact filters
    own = _with_comp(posts, comps)
    mixed = own.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high").select("key")
    left = written(own.join(mixed, "key").join(kept.select("node", *(f"p{k}" for k in range(PARITY_WORDS))), "node"))
    rest = written(candidates(left, percent))
    # first the likeliest pair of each two components, then all that still stand apart
    for last in (False, False, True):
        apart = _with_comp(_with_comp(rest, comps, "a", "ca"), comps, "b", "cb").where("ca != cb")
        if last:
            pairs = apart.select("a", "b")
        else:
            best = apart.groupBy(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")).agg(F.min_by(F.struct("a", "b"), F.struct("d", "a", "b")).alias("p"))
            pairs = best.select("p.a", "p.b")
        pairs = written(pairs)
        if pairs.isEmpty():
            break
        comps = joined_by(links(pairs, kept, percent))
    return comps


def node_links(kept: DataFrame, comps: DataFrame, copies: DataFrame, percent: int, block: int = 512) -> DataFrame:
    """(node, links): rows with another set that links with the node's, for nodes that have any. copies: (node, copies) rows of each set.

    Links lie inside components. A component is cut into blocks of about ``block`` nodes, and block meets block in a group of its own, where
    overlaps are products of matrices; what goes on are sums for each node, never pairs. Small components share groups.
    """
    members = _with_comp(kept.select("node"), comps)
    sizes = members.groupBy("comp").agg(F.count("*").alias("k")).where("k > 1")
    members = members.join(sizes, "comp")
    inside = written(kept.select("node", "n", "segments").join(members, "node").join(copies, "node"))
    sizes = inside.select("comp", "k").distinct()
    small = sizes.where(F.col("k") <= block // 8).agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
    bundles = max(1, -(-small // block))
    parts = F.when(F.col("k") <= block, 1).otherwise(F.ceil(F.col("k") / block)).cast("int")
    rows = inside.withColumn("own", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    alone = F.col("k") <= block // 8
    rows = rows.withColumns({"bundle": F.when(alone, F.pmod(F.xxhash64("comp"), F.lit(bundles))).otherwise(F.col("comp")), "alone": alone, "low": F.least("own", "other"), "high": F.greatest("own", "other")})

    def met(frame: pd.DataFrame) -> pd.DataFrame:
        low, high = int(frame["low"].iloc[0]), int(frame["high"].iloc[0])
        out = []
        for _, rows in frame.groupby("comp"):
            x, y = rows[rows["own"] == low], rows[rows["own"] == high]
            linked = _linked(_sets_of(x), _sets_of(y), percent, sizes=(x["n"].to_numpy(), y["n"].to_numpy()))
            if low == high:
                np.fill_diagonal(linked, False)
            out.append((x["node"].to_numpy(), linked @ y["copies"].to_numpy()))
            if low != high:
                out.append((y["node"].to_numpy(), linked.T @ x["copies"].to_numpy()))
        return pd.DataFrame({"node": np.concatenate([a for a, _ in out]), "links": np.concatenate([b for _, b in out]).astype(np.int64)})

    found = rows.groupBy("bundle", "alone", "low", "high").applyInPandas(met, "node long, links long")
    return found.groupBy("node").agg(F.sum("links").alias("links"))


def _sets_of(rows: pd.DataFrame) -> list[np.ndarray]:
    return [np.concatenate([unpack(x) for x in segments]) for segments in rows["segments"]]


def _linked(left: list[np.ndarray], right: list[np.ndarray], percent: int, columns: int = 4096, sizes: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Which sets of both sides link: overlaps by products of matrices, a slice of the shingles at a time. sizes: those of
    the whole sets, where what no other set has is left out of ``left`` and ``right``."""
    here = tuple(np.array([len(s) for s in side], np.int64) for side in (left, right))
    n, m = sizes or here
    overlap = np.zeros((len(left), len(right)))
    if len(left) and len(right):
        keys = [np.concatenate(side) for side in (left, right)]
        rows = [np.repeat(np.arange(len(side)), count) for side, count in ((left, here[0]), (right, here[1]))]
        shared = np.intersect1d(keys[0], keys[1])
        places = [np.searchsorted(shared, k) for k in keys]
        hits = [(p < len(shared)) & (shared[np.minimum(p, max(len(shared) - 1, 0))] == k) if len(shared) else np.zeros(len(k), bool) for p, k in zip(places, keys, strict=True)]
        sides = []
        for p, r, hit in zip(places, rows, hits, strict=True):
            order = np.argsort(p[hit], kind="stable")
            sides.append((p[hit][order], r[hit][order]))
        for a in range(0, len(shared), columns):
            there = []
            for (p, r), count in zip(sides, (len(left), len(right)), strict=True):
                i, j = np.searchsorted(p, [a, a + columns])
                x = np.zeros((count, min(columns, len(shared) - a)), np.float32)
                x[r[i:j], p[i:j] - a] = 1
                there.append(x)
            overlap += there[0] @ there[1].T
    return 100 * overlap >= percent * (n[:, None] + m[None, :] - overlap)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, chunk_docs: int = 1500, chunk_bytes: int = 6_000_000, with_links: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, and, if asked for, n_links, the number of other rows that it links with.

    Chunks have about ``chunk_docs`` rows and ``chunk_bytes`` of text at most.
    """
    own = texts_of(docs, id_col, text_col)
    sets = written(set_table(own, size))
    nodes = sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("row"), F.count("*").alias("copies"))
    total = sets.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    chunks = chunks_for(*total, chunk_docs, chunk_bytes)
    kept = written(kept_nodes(own, nodes, chunks, size, percent))
    comps = node_components(kept, percent)
    named = nodes.join(comps, "node", "left").select("node", "doc_id", "copies", F.coalesce("comp", "node").alias("comp"))
    first = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = named.join(first, "comp")
    columns = [F.col("n").alias("n_shingles"), F.col("component_id")]
    if with_links:
        named = named.join(node_links(kept, comps, nodes.select("node", "copies"), percent), "node", "left").withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
        columns.append(F.col("n_links"))
    full = sets.where("node is not null").join(named.drop("doc_id", "copies", "comp", "links"), "node").select("doc_id", *columns)
    bare = sets.where("node is null").withColumns({"component_id": F.col("doc_id"), "n_links": F.lit(0).cast("long")})
    return full.unionByName(bare.select("doc_id", *columns))
