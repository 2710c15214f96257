"""Chat formatting, periodic runs and source divergence against DuckDB and brute force."""

import collections
import hashlib
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mendwright.llm import chat_format, periodic_runs, queries, source_divergence

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def from_duckdb(name, columns):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(columns)
    return sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=repr)


# chat formatting


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_chat(rows):
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in by.items():
        turns = [t[2:] for t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)))
    return sorted(out, key=repr)


def test_chat_query_is_the_sql(spark):
    df = queries.op11_chat_format(spark, SF)
    assert rows_of(df) == from_duckdb("op11_chat_format", df.columns)
    trap = df.where("conv_id = -1").first()
    assert (trap.n_turns, trap.loss_chars, trap.n_misplaced, trap.complete) == (2, 21, 0, True)
    assert trap.turns_sha256 == sha("user\n</s>[INST] ok [/INST]\nassistant\n</s>[INST] ok [/INST]\n")


ODD = [
    (1, 0, "user", None), (1, 1, "assistant", ""), (2, 0, None, "x"), (2, 1, "tool [TEXT] \\", "[/ROLE]\\[ROLE]"), (3, None, "user", "\\"), (3, 0, "user", "\\\\[INST]"), (3, 0, "assistant", "<\\s>"),
    (3, 0, "assistant", "<\\s>"), (3, 5, "system", "[[SYS]] [/SYS] [/SYS"), (None, 1, "user", "a b\x00"), (None, 0, "assistant", " </s> </s"), (4, 0, "assistant", "é" * 300_000 + "</s>"), (4, 1, "assistant", "]"),
]


def test_chat_odd(spark):
    df = spark.createDataFrame([(*r, "extra", 0) for r in ODD], "conv_id long, turn long, role string, text string, segment string, LOSS int")
    got = chat_format.read_back(chat_format.segments(df))
    assert sorted((tuple(r)[:5] for r in got.collect()), key=repr) == plain_chat(ODD)
    by = {r.conv_id: r for r in got.collect()}
    assert (by[1].n_misplaced, by[1].complete) == (0, True)
    assert by[2].n_misplaced == 2 and not by[2].complete
    assert by[4].n_misplaced == 2 and by[4].formatted_chars == 300_000 + 5 + 1 + 2 * 9
    assert chat_format.read_back(chat_format.segments(df.limit(0))).collect() == []


def test_segments(spark):
    df = spark.createDataFrame([(7, 1, "assistant", "[INST]"), (7, 0, "user", "hi")], "conv_id int, turn int, role string, text string")
    got = chat_format.segments(df).orderBy("segment").collect()
    assert [r.text for r in got] == ["[INST] ", "hi", " [/INST]", "<s> ", "[\\INST]", " </s>"]
    assert [r.loss for r in got] == [False, False, False, False, True, False] and all(r.fits for r in got)
    assert "conv_id" in got[0] and chat_format.segments(df).schema["conv_id"].dataType.simpleString() == "int"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "tool"]), st.text(st.sampled_from("<>[]/\\sINTSY ROLEX\n"), max_size=40)), max_size=6))
def test_every_text_comes_back(turns):
    t = chat_format.TEMPLATE
    escaper = t.escaper()
    reader, out = chat_format.Reader(t), []
    for role, text in turns:
        m = t.marks(role, escaper)
        for piece in (m.opening, chat_format.escape(text, escaper), m.closing):
            out += reader.feed(piece)
    reader.end()
    assert out == turns


def test_a_long_conversation_is_streamed(spark):
    df = spark.range(60_000).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "repeat('<s>', 5) as text")
    got = chat_format.read_back(chat_format.segments(df)).first()
    assert (got.n_turns, got.loss_chars, got.n_misplaced, got.complete) == (60_000, 30_000 * 15, 0, True)


@pytest.mark.parametrize("marks", [("[[A]]", "[/A]"), ("[A] ", ""), ("<a b>", "</a>"), ("\\a", "[/A]")])
def test_faulty_templates(marks):
    with pytest.raises(ValueError):
        chat_format.Template({"user": chat_format.Marks(*marks)}, ("[R] ", " [T] ", " [/R]"), {}, frozenset())


# periodic runs


def brute_runs(s, least=12):
    n, found = len(s), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and s[j] == s[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def brute_document(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(w)
    gone = {i for a, m, q in runs for i in range(a + q, a + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *first, sha("".join(f"{a},{m},{q}\n" for a, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.mark.parametrize("letters,size", [("a", 40), ("ab", 120), ("abc", 200), ("abcdefghij", 300)])
def test_main_lorentz_is_brute_force(letters, size):
    r = random.Random(size)
    for _ in range(80):
        s = [r.choice(letters) for _ in range(r.randrange(size))]
        for _ in range(r.randrange(4)):
            unit = [r.choice(letters) for _ in range(r.randrange(1, 30))]
            at = r.randrange(len(s) + 1)
            s[at:at] = (unit * 8)[: r.randrange(2, 8 * len(unit) + 1)]
        ids = periodic_runs.word_numbers([x.encode() for x in s])
        assert periodic_runs.runs_of(ids) == brute_runs(s)
        assert periodic_runs.main_lorentz(ids.tolist(), 5) == brute_runs(s, 5)
        assert periodic_runs.runs_of(ids, 5) == brute_runs(s, 5)


def test_masking_leaves_repeated_grams_alone():
    ids = np.array([*range(100), *range(50), *range(1000, 1100)])
    assert periodic_runs.surviving(ids, 6) == [(0, 50), (100, 150)]
    assert periodic_runs.surviving(np.arange(500), 6) == []


def test_runs_query_is_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert rows_of(queries.op12_periodic_runs(spark, SF)) == sorted((brute_document(d.doc_id, d.text) for d in docs), key=repr)


def test_runs_odd(spark):
    long = "x y z " * 2 + "a\x1cb " * 3000
    docs = [(1, None), (2, ""), (3, " \n\t"), (12, "a " * 12), (12, "a " * 12), (None, "a " * 11), (None, "é　b " * 12), (2**60, long), (45, "q " * 13), (7, "Aa aA " * 9)]
    df = spark.createDataFrame([(i, t, 1, "b") for i, t in docs], "doc_id long, text string, start long, id_text string")
    got = periodic_runs.find_runs(df, plant=True)
    assert rows_of(got) == sorted((brute_document(*d) for d in docs), key=repr)
    assert periodic_runs.find_runs(df.limit(0)).collect() == []
    plain = periodic_runs.find_runs(df.where("doc_id = 45")).first()
    assert (plain.start, plain.length, plain.period, plain.exponent_milli) == (0, 13, 1, 13000)


def test_long_runs_take_no_square_time():
    began = time.time()
    assert periodic_runs.runs_of(np.zeros(30_000, np.int64)) == [(0, 30_000, 1)]
    assert len(periodic_runs.runs_of(np.tile(np.arange(10_000), 3))) == 1
    assert time.time() - began < 20


# source divergence


def brute_audit(docs):
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))) for lang, source, text in docs]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = collections.Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, c in df.items() if c >= 3)
        count = {s: collections.Counter(t for d in own if d[1] == s for t in d[2] if df[t] >= 3) for s in {d[1] for d in own}}
        whole = sum(count.values(), collections.Counter())

        def shares(c):
            total = sum(c.values()) + len(kept)  # noqa: B023
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}  # noqa: B023

        p, base = {s: shares(c) for s, c in count.items()}, shares(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in count:
            pair = [("pair", o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in count if o != s]
            term = [("term", t, f(p[s][t], base[t])) for t in kept if count[s][t] and p[s][t] > base[t]]
            for found, most in ((pair, len(pair)), (term, 200)):
                found.sort(key=lambda x: (-x[2], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (part, item, value) in enumerate(found[:most])]
    return sorted(out, key=repr)


def test_audit_query_is_the_sql_and_brute_force(spark):
    df = queries.op13_source_divergence(spark, SF)
    got = rows_of(df)
    assert got == from_duckdb("op13_source_divergence", df.columns)
    assert got == brute_audit([(r.lang, r.source, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])


def odd_sources(r):
    made = [("l", f"s{k % 40}", " ".join(r.choice(["the", "The", "éa", "b", "c'd", "x9y", "漢字"] + [f"w{'abcdefghij'[r.randrange(10)]}"] * 3) for _ in range(r.randrange(30)))) for k in range(160)]
    return [*made, *made[:3], (None, "s", None), (None, None, "the the"), ("m", "a", "x"), ("m", "b", "x"), ("m", "c", ""), ("n", "only", "x x"), ("n", "only", "x"), ("n", "only", "X"), ("o", "a", "x"), ("o", "a", "x x y"), ("o", "b", "x")]


@pytest.mark.parametrize("block,held", [(256, 10**6), (4, 3)])
def test_audit_odd(spark, block, held, monkeypatch):
    docs = odd_sources(random.Random(5))
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "lang string, source string, text string, n int, TERM string")
    monkeypatch.setattr(source_divergence, "MOST_SENT", 10**6 if block == 256 else 0)
    monkeypatch.setattr(source_divergence, "MOST_PAIRS", 10**6 if block == 256 else 7)
    assert rows_of(source_divergence.audit(df, block=block)) == brute_audit(docs)
    assert source_divergence.audit(df.limit(0)).collect() == []


def test_large_counts_divide_exactly(spark):
    r = random.Random(1)
    cases = [(0, 1), (0, 2), (6 * 10**11, 9 * 10**12), (10**15, 8 * 10**15), (0, 8 * 10**15)] + [(r.randrange(10**14), 10**14 + r.randrange(10**15)) for _ in range(50)]
    df = spark.createDataFrame(cases, "c long, d long")
    from pyspark.sql import functions as F

    assert [x[0] for x in df.select(source_divergence._share(F.col("c"), F.col("d"))).collect()] == [1 + 10**9 * (c + 1) // d for c, d in cases]
