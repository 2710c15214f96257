"""Golden cases of the operators, and their behaviour on nulls and empty tables."""

import json
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from mendwright.functions.expr import char_ngrams, elapsed_days, js_round, parse_date, size_label
from mendwright.operators import cascade, expiry, learned, records, reports, rules, similarity, synthetic, years
from mendwright.sources import files
from mendwright.streaming import events

YEARS = [
    ("2026", "2025", True, 1.0, "future_year_corrected_to_2025"), ("3000", "2025", True, 1.0, "future_year_corrected_to_2025"), ("2025", "2025", False, 1.0, "no_correction_needed"),
    ("2o25", "2025", True, 0.9, "ocr_correction"), ("2O26", "2025", True, 0.9, "ocr_correction+future_year_corrected_to_2025"), ("202B", "2020", True, 0.7, "year_completion"),
    ("202", "2020", True, 0.7, "year_completion"), ("203", "2025", True, 0.8, "invalid_old_year_corrected_to_2025"), ("26", "2025", True, 0.8, "century_completion_2000s+future_year_corrected_to_2025"),
    ("50", "2025", True, 0.8, "invalid_old_year_corrected_to_2025"), ("99", "1999", True, 0.8, "century_completion_1900s"), ("19", "2019", True, 0.8, "century_completion_2000s"), ("l9", "2019", True, 0.8, "century_completion_2000s"),
    ("1979", "1979", False, 0.9, "old_year_accepted"), ("1850", "2025", True, 0.8, "invalid_old_year_corrected_to_2025"), ("", "", False, 0.0, "empty_or_invalid_input"), ("abc", "", False, 0.0, "empty_or_invalid_input"),
    (None, "", False, 0.0, "empty_or_invalid_input"), ("0", "2025", True, 0.8, "invalid_old_year_corrected_to_2025"), ("2028.0", "2025", True, 1.0, "future_year_corrected_to_2025"), ("2024.0", "2024", True, 1.0, "no_correction_needed"),
    ("2024 ", "2024", True, 1.0, "no_correction_needed"), ("99999999999", "2025", True, 1.0, "future_year_corrected_to_2025"),
]


def test_years(spark):
    df = spark.createDataFrame([(i, y[0]) for i, y in enumerate(YEARS)], "i int, y string")
    got = years.validated(df, "y").orderBy("i").collect()
    for r, (_, text, applied, confidence, reason) in zip(got, YEARS, strict=True):
        assert (r["y_validated"], r["y_correction_applied"], r["y_confidence"], r["y_correction_reason"]) == (text, applied, confidence, reason), r


@pytest.mark.parametrize("threshold,applied", [(0.5, True), (0.7, True), (0.9, True), (0.95, False)])
def test_year_threshold(spark, threshold, applied):
    r = years.validated(spark.createDataFrame([("2o26",)], "y string"), "y", threshold).first()
    assert r["y_correction_applied"] is applied and r["y_validated"] == ("2025" if applied else "2o26")


def test_match_year(spark):
    cases = {"49": None, "30": 2030, "50": 1950, "99": 1999, "2024.7": 2024, "1899": None, "2031": None, "abc": None, "inf": None}
    df = spark.createDataFrame([(k,) for k in cases], "y string")
    assert {r["y"]: r["m"] for r in df.select("y", years.match_year(F.col("y")).alias("m")).collect()} == cases


MASTER = [("toyota", "vios", 2010, 2025), ("toyota", "camry", 2005, 2025), ("honda", "city", 2008, 2025), ("honda", "civic", 2000, 2025), ("perodua", "myvi", 2005, 2025), ("perodua", "axia", 2014, 2025), ("proton", "saga", 2000, 2025), ("proton", "x70", 2019, 2025)]


def test_matching(spark):
    master = spark.createDataFrame([(*m, i) for i, m in enumerate(MASTER)], "brand string, model string, year_start int, year_end int, position int")
    cases = [
        ("WXY 1234", "Toyota", "Vios", "2015", 1.0, "correct"), ("WXY 1234", "toyot", "vios", "2015", 0.9636, "typo_brand"), ("W 1", "toyota", "vios", "2015", 1.0, "plate_format_error"), ("WXY 1234", "toyota", "vios", "2001", 0.8, "invalid_year"),
        ("WXY 1234", "toyota", "vios", None, 0.8, "missing_year"), ("WXY 1234", "proton", "X70", "2020", 0.8667, "typo_model"), ("WXY 1234", "zzz", "qqq", "2015", 0.0, "no_match_found"),
    ]
    users = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "key int, plate string, brand string, model string, year string")
    got = {r["key"]: r for r in similarity.error_types(similarity.best_matches(users, master), F.col("plate")).collect()}
    for i, c in enumerate(cases):
        assert (round(got[i]["confidence_score"], 4), got[i]["error_types"]) == c[4:], c


def test_gestalt_keeps_its_order(spark):
    pairs = [("toyot", "toyota"), ("tide", "diet"), ("diet", "tide"), ("TOYOTA", "toyota"), ("x7o", "x70"), ("", "a"), (None, "a")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", similarity.gestalt(F.col("a"), F.col("b")).alias("r")).collect()
    for r in got:
        assert r["r"] == (SequenceMatcher(None, r["a"], r["b"]).ratio() if r["a"] and r["b"] else 0.0)


def test_comprehensive_on_empty_master(spark):
    users = spark.createDataFrame([(1, "toyot", None, "2o25")], "key int, brand string, model string, year string")
    empty = spark.createDataFrame([], "brand string, model string")
    r = similarity.comprehensive(users, empty).first()
    assert (r["brand"], r["model"], r["year"]) == ("toyot", None, "2025") and len(r["corrections"]) == 1


def test_expiry_bounds(spark):
    now = F.lit("2024-05-10 12:00:00").cast("timestamp_ntz")
    days = {"2024-05-09": ("expired", "expired"), "2024-05-10": ("expiring", "expiring"), "2024-06-09": ("expiring", "expiring"), "2024-06-10": ("valid", "ok")}
    df = spark.createDataFrame([(d,) for d in [*days, None]], "d string").withColumn("t", F.col("d").cast("timestamp_ntz"))
    for r in df.select("d", expiry.calendar_class(F.col("t"), now).alias("a"), expiry.elapsed_class(F.col("t"), now).alias("b"), elapsed_days(F.col("t"), now).alias("n")).collect():
        assert (r["a"], r["b"]) == days.get(r["d"], ("none", "none"))


def test_expressions(spark):
    r = spark.range(1).select(js_round(F.lit(2.5)).alias("a"), js_round(F.lit(-2.5)).alias("b"), size_label(F.lit(999)).alias("c"), size_label(F.lit(1000)).alias("d"), size_label(F.lit(1500000)).alias("e"), char_ngrams(F.lit("abc"), 2, 4).alias("g"), parse_date(F.lit("31.12.2020")).cast("date").cast("string").alias("p"), parse_date(F.lit("no")).alias("q")).first()
    assert (r["a"], r["b"], r["c"], r["d"], r["e"], r["g"], r["p"], r["q"]) == (3, -2, "999 B", "1.0 KB", "1.5 MB", ["ab", "bc", "abc"], "2020-12-31", None)


def test_plates(spark):
    cases = {"ABC 1234": (True, True), "AB123": (True, True), "W 1": (False, True), "W1234A": (False, True), "ABC12": (False, True), "1234": (False, False), None: (False, False)}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r["p"]: (r["a"], r["b"]) for r in df.select("p", rules.plate_strict(F.col("p")).alias("a"), rules.plate_wide(F.col("p")).alias("b")).collect()} == cases


def test_cascade_and_votes(spark):
    inputs = spark.createDataFrame([(1, "Toyot"), (2, " "), (3, None), (4, "hond"), (5, "zz")], "key int, input string")
    direct = spark.createDataFrame([("toyot", "toyota", 1.0)], "input string, correction string, confidence double")
    fuzzy = spark.createDataFrame([("hond", "honda", 0.6)], "input string, correction string, confidence double")
    got = {r["key"]: r["method"] for r in cascade.correct(inputs, direct, fuzzy, []).collect()}
    assert got == {1: "direct_mapping", 2: "no_input", 3: "no_input", 4: "no_correction", 5: "no_correction"}
    votes = spark.createDataFrame([(1, "rule", "a", 1.0), (1, "ml", "a", 1.0), (2, "ml", "b", 1.0)], "key int, model string, candidate string, confidence double")
    assert {r["key"]: (r["candidate"], r["score"]) for r in cascade.vote(votes).collect()} == {1: ("a", 0.8), 2: (None, 0.5)}


def test_histogram_of_nothing(spark):
    assert reports.histogram(spark.createDataFrame([], "v double"), "v").count() == 0
    assert {r["bin"]: r["n"] for r in reports.histogram(spark.createDataFrame([(float(x),) for x in range(11)], "v double"), "v").collect()}[10] == 2


def test_typos_are_stable(spark):
    a = synthetic.faulty(F.col("t"), F.col("k"), F.lit("delete"))
    df = spark.createDataFrame([(1, "toyota"), (2, "x"), (3, None)], "k int, t string")
    one, two = df.select(a.alias("a")).collect(), df.repartition(3).orderBy("k").select(a.alias("a")).collect()
    assert one == two and len(one[0]["a"]) == 5 and one[1]["a"] == "x" and one[2]["a"] is None


def test_set_changes(spark):
    rows = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "id int, parent int")
    gone = spark.createDataFrame([(10,)], "p int")
    assert {r["id"]: r["parent"] for r in records.set_null(rows, gone, "parent", "p").collect()} == {1: None, 2: 20, 3: None}
    assert [r["p"] for r in records.restricting(rows, gone, "parent", "p").collect()] == [10]
    assert [r["id"] for r in records.orphans(rows, "parent", gone, "p").collect()] == [2]


def test_sources(spark, tmp_path):
    df = files.inline(spark, [("toyota", "vios", 2010, 2025)], files.MASTER_SCHEMA)
    files.write_csv(df, f"{tmp_path}/m")
    assert files.read_csv(spark, f"{tmp_path}/m", files.MASTER_SCHEMA).collect() == df.collect()
    files.write_json(df, f"{tmp_path}/j")
    assert files.read_json(spark, f"{tmp_path}/j", files.MASTER_SCHEMA).collect() == df.collect()
    (tmp_path / "up").mkdir()
    for name, size in (("a.png", 10), ("b.exe", 10), ("c.pdf", files.MAX_UPLOAD + 1)):
        (tmp_path / "up" / name).write_bytes(b"x" * size)
    found = files.files(spark, f"{tmp_path}/up/*")
    assert [r["path"].rsplit("/", 1)[1] for r in files.uploads(found).collect()] == ["a.png"]
    assert files.newest(found).count() == 1
    assert files.extracted(files.uploads(files.files(spark, f"{tmp_path}/up/*", content=True))).first()["extracted_text"] is None


def test_model_round_trip(spark, tmp_path):
    train = spark.createDataFrame([(f"r{i}", t, c) for i, (t, c) in enumerate([("toyot", "toyota"), ("toyotaa", "toyota"), ("hond", "honda"), ("hondaa", "honda")] * 3)], "row_id string, input_text string, correct_text string")
    learned.save(learned.fit(train, "naive_bayes", 100), f"{tmp_path}/model")
    got = learned.predict(learned.load(f"{tmp_path}/model"), train)
    assert got.where("predicted = correct_text").count() == 12


def test_stream(spark, tmp_path):
    spark.sql("select cast(id as bigint) event_id, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,id) ts, 'a' event_type from range(48)").write.parquet(f"{tmp_path}/e")
    got = events.drained(events.daily_counts(events.event_stream(spark, f"{tmp_path}/e")), "daily")
    assert sorted(r["n"] for r in got.collect()) == [24, 24]


@pytest.mark.parametrize("a,b,score", [("honda", "honda", 100), ("Honda!", "honda", 100), ("hond", "honda", 89), ("civic honda", "honda civic", 95), ("honda", "honda civic type r", 90), ("", "x", 0), (None, "x", 0), ("abc", "xyz", 0), ("ab", "ab cd ef gh ij kl", 60)])
def test_weighted_ratio(a, b, score):
    assert similarity.weighted_percent(a, b) == score


def test_extract_one_is_brute_force(spark):
    r = random.Random(4)
    words = ["honda", "civic", "toyota", "corolla", "type", "r", "x1", "city"]
    text = lambda: " ".join(r.choices(words, k=r.randrange(1, 4)))
    spoil = lambda t: "".join(c for c in t if r.random() > 0.15).replace("o", "0")
    cands = sorted({text() for _ in range(40)})
    ins = sorted({spoil(text()) for _ in range(40)} | {"", "Civic, Honda!"})
    expected = {}
    for x in ins:
        score, best = max(((similarity.weighted_percent(x, c), c) for c in cands), key=lambda p: (p[0], [-ord(ch) for ch in p[1]]))
        if score >= 70:
            expected[x] = score
    inputs, master = spark.createDataFrame([(x,) for x in ins], "input string"), spark.createDataFrame([(x, x) for x in cands], "candidate string, position string")
    got = similarity.extract_one(inputs, master).collect()
    assert {g["input"]: g["score"] for g in got} == expected
    assert all(g["candidate"] == min(c for c in cands if similarity.weighted_percent(g["input"], c) == g["score"]) for g in got)


def test_enhanced_years(spark):
    users = spark.createDataFrame([(1, "2030"), (2, "2019"), (3, None), (4, "l9"), (5, "abc")], "key long, year string")
    plain = {r["key"]: r for r in similarity.enhanced_years(users, None).collect()}
    assert [plain[k]["final_year"] for k in range(1, 6)] == ["2025", "2019", "", "2019", "abc"]
    assert plain[1]["methods"] == "year_validation" and plain[2]["corrections"] == [] and plain[2]["confidence"] == 1.0
    master = spark.createDataFrame([("2024",), ("1999",)], "candidate string")
    near = {r["key"]: r for r in similarity.enhanced_years(users, master).collect()}
    assert (near[1]["final_year"], near[1]["methods"], near[1]["confidence"]) == ("2024", "year_validation,autocorrect", 0.75)
    assert [near[k]["final_year"] for k in (2, 3, 5)] == ["2019", "", "abc"]
    stats = similarity.enhanced_statistics(similarity.enhanced_years(users, master)).first()
    assert (stats["total_records"], stats["future_years_corrected"], stats["validation_corrections"], stats["no_corrections"]) == (5, 1, 2, 3)
    assert similarity.enhanced_statistics(similarity.enhanced_years(users.limit(0), master)).first()["correction_rate"] == 0.0


def test_inputs_from_csv_to_csv(spark, tmp_path):
    (tmp_path / "in.csv").write_text("key,plate,brand,model,year\n1,WXY 1234,T0yota,Corola,2015\n2,W 1,,zzz,\n")
    users = spark.read.csv(str(tmp_path / "in.csv"), header=True, schema="key long, plate string, brand string, model string, year string")
    master = spark.createDataFrame([("toyota", "corolla", 2000, 2020, 1)], "brand string, model string, year_start int, year_end int, position int")
    similarity.processed_inputs(users, master).write.csv(str(tmp_path / "out"), header=True)
    rows = {r["user_input_plate"]: r for r in spark.read.csv(str(tmp_path / "out"), header=True).collect()}
    assert len(rows["W 1"]) == 14 and rows["W 1"]["error_types"] == "plate_format_error, no_match_found" and rows["W 1"]["matched_brand"] is None
    assert (rows["WXY 1234"]["matched_model"], rows["WXY 1234"]["error_types"], rows["WXY 1234"]["normalized_brand"]) == ("corolla", "typo_model", "toyota")


def test_faults_of_a_dataset(spark):
    values = spark.createDataFrame([("brand", "toyota", 1), ("model", "corolla", 1), ("combined", "toyota corolla", 1)], "field_type string, value string, position int")
    rows = synthetic.dataset(values, 300).collect()
    assert {r["field_type"]: max(x["n_faults"] for x in rows if x["field_type"] == r["field_type"]) for r in rows} == {"brand": 2, "model": 2, "combined": 3}
    assert all(abs(len(r["input_text"]) - len(r["correct_text"])) <= r["n_faults"] for r in rows) and {r["correction_type"] for r in rows} == {"synthetic"}


@pytest.mark.parametrize("kind", ["svm", "gradient_boosting"])
def test_slow_classifiers_on_two_labels(spark, kind):
    rows = [(str(k), ("toyota" if k % 2 else "honda") + "x" * (k % 3), "toyota" if k % 2 else "honda") for k in range(24)]
    train = spark.createDataFrame(rows, "row_id string, input_text string, correct_text string")
    told = learned.predict(learned.fit(train, kind, 50), train, kind=kind).collect()
    assert all(r["predicted"] == r["correct_text"] for r in told)
    assert json.loads(learned.metadata(kind, 0.9, 0.1, 50, 2, "2024-01-01"))["accuracy"] == {"mean": 0.9, "std": 0.1}


def test_logs_and_inspection(spark, tmp_path):
    lines = [{"level": "INFO", "message": "a", "timestamp": "2024-01-01T00:00:00Z", "service": "s", "more": 1}, {"level": "ERROR", "message": None}]
    (tmp_path / "app.log").write_text("\n".join(map(json.dumps, lines)))
    logs = files.read_logs(spark, f"{tmp_path}/app.log")
    assert [tuple(r) for r in logs.orderBy("level").collect()] == [("ERROR", None, None, None), ("INFO", "a", "2024-01-01T00:00:00Z", "s")]
    rows, columns, some = files.inspect(logs, 1)
    assert (rows, columns, some.count()) == (2, ["level", "message", "timestamp", "service"], 1)
