"""Fingerprints, the Jaccard join, LM scoring and the pipeline against brute force."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest

import corpus_pipeline
from mendwright.llm import common, iblt, jaccard_join, lm_score, packed, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {k: k + 32 for k in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


# fingerprints


def near(a, b):
    pieces = re.compile(r"[^\n]{1,240}[^\n \t\x0b\f\r]*").findall
    x, y = set(pieces(a)), set(pieces(b))
    return len(x & y) / len(x | y) if x | y else 1.0


def check_fingerprints(rows, docs):
    docs = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))
    texts = [t or "" for _, t in docs]
    expected = []
    for k, (i, _) in enumerate(docs):
        t, n = texts[k], texts[(k + 1) % len(texts)]
        h = len(t) // 2
        edited = t[: len(t) - h] + n[:h]
        expected.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(near(t, edited), 9), round(near(t, n), 9)))
    got = [(r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in rows]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_fingerprints(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = queries.op2_iblt_fingerprints(spark, SF).collect()
    check_fingerprints(rows, docs)
    by_id, seen = dict(docs), {}
    for r in rows:
        assert seen.setdefault(by_id[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]


def test_fingerprints_odd(spark):
    r = random.Random(2)
    lines = lambda n: "\n".join(f"line {r.randrange(10**9)}" for _ in range(n))
    docs = [(1, None), (2, ""), (3, "a"), (3, "a"), (3, "b"), (None, "x\ny"), (9, lines(400)), (10, lines(300)), (12, "é" * 700), (13, "same\n" * 50)]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, keys int")
    check_fingerprints(iblt.fingerprints(df).collect(), docs)
    check_fingerprints(iblt.fingerprints(df.limit(1)).collect(), docs[:1])
    assert iblt.fingerprints(df.limit(0)).count() == 0


def test_next_over_many_ranges(spark):
    docs = [(i * 7 % 101, f"t{i}") for i in range(101)]
    df = iblt.texts_of(spark.createDataFrame(docs, "doc_id long, text string")).selectExpr("doc_id", "text", "array(1L) keys")
    got = {r["doc_id"]: r["next_text"] for r in iblt.with_next(df, bucket_rows=5).collect()}
    by_id = dict(docs)
    assert got == {i: by_id[(i + 1) % 101] for i in range(101)}


def test_next_of_text_ids(spark):
    ids = ["", "a,b", "é", "x\x1fy", "A"] + [f"id {k}" for k in range(90)]
    docs = [(i, f"t{k}") for k, i in enumerate(ids)] + [(None, "n"), ("id 5", "u")]
    df = spark.createDataFrame(docs, "doc_id string, text string").selectExpr("doc_id", "text", "array(1L) keys")
    got = sorted(((r["doc_id"], r["text"], r["next_text"]) for r in iblt.with_next(df, bucket_rows=5).collect()), key=repr)
    order = sorted(docs, key=lambda d: (d[0] is not None, (d[0] or "").encode(), d[1]))
    assert got == sorted(((i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order)), key=repr)
    check_fingerprints(iblt.fingerprints(df.limit(0).unionByName(df.where("doc_id is null"))).collect(), [(None, "n")])


def test_fingerprints_run_no_python(spark):
    plan = queries.op2_iblt_fingerprints(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# Jaccard join


def shingles(text):
    w = words(text)
    k = min(5, len(w))
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()


def brute_components(docs):
    sets = [shingles(t) for _, t in docs]
    above = list(range(len(docs)))

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                above[top(a)] = top(b)
    first = {}
    for k, (i, _) in enumerate(docs):
        first[top(k)] = min(first.get(top(k), i), i)
    return sorted((i, len(sets[k]), first[top(k)]) for k, (i, _) in enumerate(docs))


def rows_of(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())


def brute_links(docs):
    """Other rows that each row links with."""
    sets = [shingles(t) for _, t in docs]
    near = lambda a, b: bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)
    return sorted(((i, sum(near(a, b) for k, b in enumerate(sets) if k != j)) for j, ((i, _), a) in enumerate(zip(docs, sets, strict=True))), key=repr)


def links_of(df):
    return sorted(((r["doc_id"], r["n_links"]) for r in df.collect()), key=repr)


def test_join(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = queries.op7_jaccard_join(spark, SF)
    assert rows_of(found) == brute_components(docs) and links_of(found) == brute_links(docs)


def test_links_in_blocks(spark, monkeypatch):
    r = random.Random(11)
    base = [f"w{k}" for k in range(150)]
    docs = []
    for k in range(90):  # one large group of near copies, some of them equal
        t = list(base)
        for _ in range(r.randrange(6)):
            t[r.randrange(150)] = f"x{r.randrange(400)}"
        docs.append((k, " ".join(t)))
    docs += [(200 + k, " ".join(f"g{k // 3}v{j}" for j in range(40)) + f" e{k % 3}") for k in range(30)] + [(300, None), (301, ""), (None, docs[0][1]), (5, docs[5][1])]
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, n_links int")
    for block in (512, 16):
        monkeypatch.setattr(jaccard_join.node_links, "__defaults__", (block,))
        got = jaccard_join.classes(df, chunk_docs=20, with_links=True)
        assert links_of(got) == brute_links(docs)
    assert jaccard_join.classes(df.limit(0), with_links=True).columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    assert jaccard_join.classes(df.where("doc_id >= 300"), with_links=True).count() == 2


def test_linked_in_slices():
    r = np.random.default_rng(2)
    left, right = ([np.unique(r.integers(0, 60, r.integers(1, 60)).astype(np.uint64)) for _ in range(20)] for _ in range(2))
    near = [[100 * len(np.intersect1d(a, b)) >= 40 * len(np.union1d(a, b)) for b in right] for a in left]
    for columns in (4096, 7):
        assert (jaccard_join._linked(left, right, 40, columns) == np.array(near)).all() and np.any(near)


def test_join_odd_and_chained(spark):
    r = random.Random(3)
    vocabulary = [f"v{k}" for k in range(300)]
    base = r.choices(vocabulary, k=120)
    docs = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one TWO"), (6, "two one"), (7, "a b c d e"), (8, "a b c d e")]
    chain = list(base)
    for k in range(12):  # each differs from the one before by a word or two: links chain on
        docs.append((100 + k, " ".join(chain)))
        chain = list(chain)
        chain[(7 * k) % 120] = f"new{k}"
    passage = " ".join(r.choices(vocabulary, k=60))
    docs += [(200 + k, passage + " " + " ".join(r.choices(vocabulary, k=30))) for k in range(15)]
    docs += [(300 + k, " ".join(base[:60] + r.choices(vocabulary, k=60))) for k in range(5)]
    df = spark.createDataFrame([(i, t, "q") for i, t in docs], "doc_id long, text string, component_id string")
    linked = jaccard_join.classes(df, chunk_docs=7, with_links=True)
    assert rows_of(linked) == brute_components(docs) and links_of(linked) == brute_links(docs)
    assert rows_of(jaccard_join.classes(df, chunk_bytes=2000)) == brute_components(docs)
    assert jaccard_join.classes(df.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(1000 + k, 1001 + k) for k in range(40)]
    got = {x["node"]: x["comp"] for x in jaccard_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    above = {x: x for e in edges for x in e}
    for _ in range(len(above)):
        for a, b in edges:
            above[a] = above[b] = min(above[a], above[b])
    assert {x: got.get(x, x) for x in above} == above and got[1040] == 1000
    assert jaccard_join.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shared_passage_makes_no_pairs(spark):
    """5,000 texts share a passage; none links. They must not be held against each other."""
    r = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(90))
    docs = [(k, f"{passage} " + " ".join(f"w{r.randrange(10**6)}" for _ in range(14))) for k in range(5000)]
    docs += [(6000 + k, f"{passage} " + " ".join(f"x{j}" for j in range(14)) + f" y{k}") for k in range(3)]
    own = jaccard_join.texts_of(spark.createDataFrame(docs, "doc_id long, text string"))
    nodes = jaccard_join.set_table(own).groupBy("node").agg({"row": "min"}).withColumnRenamed("min(row)", "row")
    kept = jaccard_join.kept_nodes(own, nodes, 4, 5, 80)
    alone = jaccard_join.postings(kept).join(kept.drop("n", "keys", "places", "segments"), "node").withColumn("comp", jaccard_join.F.col("node"))
    assert 3 <= jaccard_join.candidates(alone, 80).count() <= 10
    classes = {r["doc_id"]: r["component_id"] for r in jaccard_join.classes(own).collect()}
    assert all(classes[i] == (6000 if i >= 6000 else i) for i in classes)


def test_join_repeated_and_null_ids(spark):
    r = random.Random(6)
    text = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(30))
    one, two = text(), text()
    rows = [(None, one), (None, two), (None, one + " x"), (7, one), (7, two), (7, None)]
    df = spark.createDataFrame([(*x, "c", 1) for x in rows], "doc_id long, text string, chunk string, bucket int")
    got = sorted(((x["doc_id"], x["n_shingles"], x["component_id"]) for x in jaccard_join.classes(df, chunk_docs=2).collect()), key=repr)
    assert got == sorted([(None, 26, 7), (None, 26, 7), (None, 27, 7), (7, 26, 7), (7, 26, 7), (7, 0, 7)], key=repr)


def test_long_texts_make_more_chunks():
    assert [common.chunks_for(*x, 10, 100) for x in [(0, 0), (11, 5), (11, 901)]] == [1, 2, 10]


def test_packing():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        keys = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        assert (packed.unpack(packed.pack(keys)) == keys).all()
        counts = rng.integers(0, 600, n)
        assert (packed.unpack_counts(packed.pack_counts(counts)) == counts).all()


def test_only_filled_buckets_are_messages():
    """A chunk's work grows with its own keys, not with the number of buckets; all chunks cut alike."""
    rng = np.random.default_rng(4)
    every = {}
    for bits in (21, 48, 60, 64):
        for buckets in (1, 7, 8, 5000, 3 * 10**6):
            keys = np.unique(rng.integers(0, 2**64, 300, np.uint64) >> np.uint64(64 - bits))
            parts = packed.filled(keys, bits, buckets)
            assert len(parts) <= min(len(keys), buckets) and all(j > i for _, i, j in parts)
            assert [i for _, i, _ in parts] == [0, *(j for *_, j in parts)][:-1] and parts[-1][2] == len(keys)
            assert all(b == (int(k) * buckets) >> bits for b, i, j in parts for k in keys[i:j]) or bits > 32
            assert [b for b, *_ in parts] == sorted({b for b, *_ in parts}) and parts[-1][0] < buckets
            for b, i, j in parts:
                every.update({(bits, buckets, int(k)): b for k in keys[i:j]})
            assert all(every[bits, buckets, int(k)] == packed.filled(keys[n : n + 1], bits, buckets)[0][0] for n, k in enumerate(keys[:20]))
    assert packed.filled(np.zeros(0, np.uint64), 48, 9) == []
    start = time.perf_counter()
    for _ in range(10_000):  # chunks of a very large corpus
        packed.filled(keys[:50], 64, 5000)
    assert time.perf_counter() - start < 5


def test_fragments_cut_the_global_order():
    s = np.arange(10, dtype=np.uint64) * np.uint64(3)
    df = np.array([1, 2, 3, 4, 15, 16, 255, 256, 9999, 1])
    parts = [packed.unpack(x).tolist() for x in jaccard_join._fragments(s, df)]
    assert parts == [[3, 6], [9, 12], [15, 18], [21, 24]]


# LM scoring


class Automaton:
    """The same model as plain states, arcs and failure arcs; one traversal carries the state."""

    def __init__(self, texts, order, top):
        self.order, self.counts = order, [collections.Counter() for _ in range(order)]
        for w in texts:
            for n in range(1, order + 1):
                self.counts[n - 1].update(tuple(w[k - n + 1 : k + 1]) for k in range(n - 1, len(w)))
        self.n, self.v, self.top = sum(self.counts[0].values()), len(self.counts[0]), top

    def weight(self, state):
        c = self.counts[len(state) - 1][state]
        return self.top * c / (c + 1)

    def arc(self, state, word):
        if not state:
            return (self.counts[0][(word,)] + 0.1) / (self.n + 0.1 * (self.v + 1))
        c = self.counts[len(state) - 1][state]
        a = self.weight(state)
        return a * self.counts[len(state)][(*state, word)] / c + (1 - a) * self.arc(state[1:], word)

    def score(self, w):
        state, total = (), 0.0
        for word in w:
            while state and not self.counts[len(state)][(*state, word)]:
                total += math.log10(1 - self.weight(state))  # failure arc
                state = state[1:]
            total += math.log10(self.arc(state, word))
            state = (*state, word)[-(self.order - 1) :]
            while state and not self.counts[len(state) - 1][state]:
                state = state[1:]
        return total


def test_lm(spark):
    docs = {r["doc_id"]: [*words(r["text"]), None] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = {i for i in docs if zlib.crc32(str(i).encode()) % 10 == 0}
    model = Automaton([w for i, w in docs.items() if i not in out], 3, 0.3)
    rows = queries.op10_lm_score(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        w = docs[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (r["doc_id"] in out, len(w), sum(model.counts[0][(x,)] > 0 for x in w), model.n)
        assert math.isclose(r["base_score"], sum(math.log10(model.arc((), x)) for x in w), rel_tol=1e-9)
        assert math.isclose(r["score"], model.score(w), rel_tol=1e-9)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_sums_to_one():
    model = Automaton([["a", "b", "a", "c", None], ["a", "b", None], [None]], 3, 0.3)
    for state in [(), ("a",), ("a", "b"), ("b",)]:
        assert math.isclose(sum(model.arc(state, w) for w in ["a", "b", "c", None, "unknown"]), 1)


def test_lm_carries_the_state():
    """At each position the state carried on and the weight are those of the plain automaton, and the arc taken leads to that state."""
    r = random.Random(9)
    docs = [[r.choice("abcdefgh") for _ in range(r.randrange(0, 30))] + [None] for _ in range(60)]
    for order in (1, 2, 3, 4):
        plain = Automaton(docs[::2], order, 0.3)
        tokens = np.array([ord(x) if x else 1 for w in docs for x in w], np.uint64)
        sizes = np.array([len(w) for w in docs])
        model = lm_score.Automaton(plain.n, plain.v, 0.3)
        flat = [x for w in docs for x in w]
        for n, (keys, at) in enumerate(lm_score._grams(tokens, sizes, [60] + [50] * (order - 1))):
            distinct, place = np.unique(keys, return_inverse=True)
            counts = np.zeros(len(distinct), np.int64)
            counts[place] = [plain.counts[n][tuple(flat[k - n : k + 1])] for k in at]
            model.add(counts, place, at, len(tokens))
        _, scores, carried = model.traverse(sizes)
        k = 0
        for w in docs:
            state = ()
            for word in w:
                total = 0.0
                while state and not plain.counts[len(state)][(*state, word)]:
                    total += math.log10(1 - plain.weight(state))
                    state = state[1:]
                total += math.log10(plain.arc(state, word))
                state = (*state, word)[-(order - 1) :] if order > 1 else ()
                while state and not plain.counts[len(state) - 1][state]:
                    state = state[1:]
                assert carried[k] == len(state) and math.isclose(scores[k], total, rel_tol=1e-9)
                k += 1


def test_lm_odd(spark):
    docs = [(None, None), (1, ""), (1, "a b"), (2, "A B " * 3000), (10, "x" * 10000)]
    df = spark.createDataFrame([(i, t, 1.0, "c", 2) for i, t in docs], "doc_id long, text string, score double, chunk string, bucket int")
    rows = lm_score.score(df, chunk_docs=2).collect()
    assert sorted(r["n_tokens"] for r in rows) == [1, 1, 2, 3, 6001]
    assert sorted(lm_score.score(df, chunk_bytes=1000).collect(), key=repr) == sorted(rows, key=repr)
    assert lm_score.score(df.limit(0)).count() == 0


# pipeline


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.persist()]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).persist())
    return out


def test_stages(spark, stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "byte-level BPE"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    rows = [{r["doc_id"]: r for r in s.collect()} for s in stages]
    assert len(rows[1]) == len(rows[0])
    kept = {c for _, _, c in brute_components([(i, r["text"]) for i, r in rows[1].items()])}
    assert set(rows[2]) == kept
    leaks = {r["doc_id"] for r in queries.op6_decontamination(spark, SF).collect()}
    assert set(rows[3]) == kept - leaks
    assert set(rows[4]) == set(rows[5]) == set(rows[3])
    assert not any("token = " in r["text"] and re.search(r"token = \W?[0-9a-f]{12}", r["text"]) for r in rows[4].values())
    assert all(r["n_chars"] == len(r["text"]) for r in rows[4].values())
    assert {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, SF).collect()} == {i: r["n_tokens"] for i, r in rows[5].items()}


def test_pipeline_keeps_clashing_columns(spark):
    text = "the cat and the dog are in the house with the other one"
    rows = [(k, f"{text} {k}" if k < 3 else text, "en", "s", 1, f"key {k}", k, "c") for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row_key string, `row` int, component_id string")
    whole = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF)
        assert docs.columns == whole.columns
    assert [(r["doc_id"], r["row_key"], r["row"], r["component_id"]) for r in docs.collect()] == [(0, "key 0", 0, "c")]


def test_own_names_are_free(spark):
    df = spark.createDataFrame([(1, 2)], "a int, `_A` int")
    assert common.free_name(df, "a") == "__a"
    facts = spark.createDataFrame([(k % 3, k, "x") for k in range(50)], "k int, v int, salt string")
    table = spark.createDataFrame([(0, "zero"), (1, "one")], "k int, name string")
    one, many = ({tuple(r) for r in common.looked_up(facts, table, ["k"], most_sent=n).collect()} for n in (100, 0))
    assert one == many and len(one) == 34


def test_written_files_lie_in_the_shared_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert folder.split("file:")[-1].lstrip("/") in common.written(spark.range(3)).inputFiles()[0]


def test_pipeline_odd(spark):
    text = "the cat and the dog are in the house with the other one"
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (None, text + " too", "en", None, None), (2, None, "en", "s", 0), (3, "", None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).persist()
    assert docs.count() == 1 and docs.first()["doc_id"] == 1
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).persist()
    assert docs.count() == 0
