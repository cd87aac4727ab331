import datetime
import difflib
import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from plumbline.functions import stats as S
from plumbline.operators import cascade, engines, generators, grounding, properties, providers, ranking, rules, suite
from plumbline.sources import governed
from plumbline.streaming import bus


def test_kinds_of_lexical_matches(spark):
    source = "The quick brown fox jumps over the lazy dog today. Another sentence stands here for the test."
    sentences = source.replace(". ", ".|").split("|")
    cases = [
        ("the QUICK brown   fox jumps", "exact_substring"),
        ("The quick brown fox jumped over the lazy dog today.", "near_exact"),
        ("today dog lazy the over jumps fox brown quick", "token_overlap"),
        ("A wholly different claim about something else.", "no_match"),
        ("", "exact_substring"),
    ]
    df = spark.createDataFrame([(i, s, source, sentences) for i, (s, _) in enumerate(cases)], "id int, sentence string, source string, source_sentences array<string>")
    got = {r.id: r.match for r in grounding.cleared_sentences(df).collect()}
    assert [got[i] for i in range(len(cases))] == [k for _, k in cases]
    clean = lambda s: " ".join(s.lower().split())
    for i, (s, kind) in enumerate(cases[1:4], 1):
        ratio = max(difflib.SequenceMatcher(None, clean(s), clean(x)).ratio() for x in sentences)
        assert (ratio > 0.85) == (got[i] == "near_exact") or kind == "token_overlap"


def test_driver_sends_on_what_is_open_and_keeps_flags(spark):
    rows = spark.range(6).withColumn("k", F.col("id") % 2)
    seen = []

    def layer(name, clear, flag):
        def run(left):
            seen.append((name, sorted(r.id for r in left.collect())))
            return left.withColumn("verdict", F.when(F.col("id").isin(clear), "clear").when(F.col("id").isin(flag), "flagged"))

        return name, run

    out = cascade.driver(rows, F.col("id") == 0, [layer("L2", [1], [2, 3]), layer("L3", [2], [])])
    got = {r.id: (r.resolved_by, r.supported) for r in out.collect()}
    assert got == {0: ("L1", True), 1: ("L2", True), 2: ("L3", True), 3: ("L2_flagged", False), 4: ("unresolved", False), 5: ("unresolved", False)}
    assert seen == [("L2", [1, 2, 3, 4, 5]), ("L3", [2, 3, 4, 5])]
    risk = {r.k: (r.sentences, r.unsupported, r.risk) for r in cascade.risk(out, ["k"]).collect()}
    assert risk[0] == (3, 1, 0.5 + 0.5 / 3) and risk[1] == (3, 2, 0.5 + 0.5 * 2 / 3)
    stopped = cascade.driver(rows, F.col("id") == 0, [layer("L2", [1], []), layer("L3", [2], [])], stop_after="L1")
    assert stopped.where("supported").count() == 1


def test_fact_counts_of_faulty_replies(spark):
    replies = ['{"supported": 4, "not_found": 1, "total": 9}', "```json\n{\"supported\": 1, \"contradicted\": 1,}\n```", "no", "{}", None, '{"verdict": "Grounded", "total": 0}', '{"supported": 8, "shifted": 1, "inferred": 1}', "{bad}"]
    found = cascade.fact_counts(F.col("r"))
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, r string")
    got = [tuple(r) for r in df.select("i", *[found[c].alias(c) for c in ("total", "ratio", "auto_clear", "verdict", "error")]).orderBy("i").collect()]
    assert got == [
        (0, 5, 0.8, True, "GROUNDED", False), (1, 2, 0.5, False, "HALLUCINATED", False), (2, 0, 0.0, False, None, True), (3, 0, 0.0, False, "HALLUCINATED", False),
        (4, 0, 0.0, False, None, True), (5, 0, 0.0, False, "GROUNDED", False), (6, 10, 0.8, True, "GROUNDED", False), (7, 0, 0.0, False, None, True),
    ]


def test_model_verdicts(spark):
    df = spark.createDataFrame([("SUPPORTED", False), ("unsupported", False), ("not supported", None), ("who knows", False), (None, False), ("unsupported", True)], "t string, e boolean")
    assert [r[0] for r in df.select(cascade.model_verdict(F.col("t"), F.col("e"))).collect()] == [True, False, False, False, False, True]
    assert [r[0] for r in df.select(cascade.model_verdict(F.col("t"), F.col("e"), has_key=False)).collect()] == [False] * 6


def test_attribution_windows_and_decisions(spark):
    context = "The report says that sales rose by ten percent in spring. Nothing else is known about them."
    cases = [
        ("No citations here.", (0, 0, 0, 0, "pass")),
        ("sales rose by ten percent in spring [1]", (1, 1, 0, 0, "pass")),
        ("zebras fly over purple mountains every winter [2]", (1, 0, 1, 0, "fail")),
    ]
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(cases)], "i int, r string").withColumn("c", F.lit(context))
    found = cascade.attribution(F.col("r"), F.col("c"), properties.CITATIONS, cascade.containment_score)
    assert [tuple(r)[1:] for r in df.select("i", *found.values()).orderBy("i").collect()] == [x for _, x in cases]
    none = cascade.attribution(F.col("r"), F.lit(""), properties.CITATIONS, cascade.containment_score)
    assert [tuple(r)[1:] for r in df.select("i", *none.values()).orderBy("i").collect()][1] == (1, 0, 0, 1, "fail")
    made = cascade.fabrication(F.col("r"), F.col("c"), cascade.containment_score)
    assert [r[1] for r in df.select("i", made["suspects"]).orderBy("i").collect()] == [1, 0, 1]


def test_normalized_facts(spark):
    table = '{"events": ["a fire", {"text": "a flood", "negated": true}, "", {"x": 1}], "other": []}'
    got = spark.createDataFrame([(table,)], "t string").select(cascade.normalized_facts(F.col("t"), ["events", "absent"]).alias("m")).first().m
    assert [tuple(x) for x in got["events"]] == [("a fire", False), ("a flood", True)] and got["absent"] == []


def test_extraction_asks_each_source_once(spark):
    asked = []

    def provider(rows):
        asked.append(rows.count())
        return rows.withColumn("facts", F.array(F.col("text")))

    out = cascade.extracted(spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, text string"), "k", [("one", provider), ("two", provider)], lambda f: f.withColumn("facts", F.array_compact("facts")))
    assert sorted((r.k, r["pass"], tuple(r.facts)) for r in out.collect()) == [(1, "one", ("a",)), (1, "two", ("a",)), (2, "one", ()), (2, "two", ())] and asked == [2, 2]


def test_embeddings_count_words(spark):
    df = spark.createDataFrame([("a b a",), ("",), (None,), ("word " * 5000,)], "t string")
    got = [r[0] for r in df.select(providers.hashed_embedding(F.col("t"), 16)).collect()]
    assert sorted(got[0], reverse=True)[:2] in ([2.0, 1.0], [3.0, 0.0]) and got[1] == [0.0] * 16 and max(got[3]) == 5000.0


def test_engines(spark):
    cases = spark.createDataFrame([(1, "q", "An answer"), (2, "q", "Another"), (3, "q", "")], "id int, question string, answer string")
    first = engines.judge_engine("deterministic")
    assert {"decision", "overall_score", "confidence", "flags", "engine"} <= set(first(cases).columns)
    broken = lambda rows: first(rows).withColumn("error", F.when(F.col("id") == 2, "down"))
    other = lambda rows: first(rows).withColumn("engine", F.lit("second"))
    assert {r.id: r.engine for r in engines.judge_engine("fallback", primary=broken, second=other)(cases).collect()} == {1: "deterministic", 2: "second", 3: "deterministic"}
    many = engines.judge_engine("debiased", judge=first, key=["id"])(cases)
    assert many.count() == 3 and all(r.flags == [] for r in many.collect())
    refused = engines.judge_engine("calibrated", judge=first, allowed=False, reason="blocked")(cases).first()
    assert refused.decision is None and refused.flags == ["trust_gate:blocked"]
    model = lambda rows: first(rows).withColumn("decision", F.lit("pass"))
    whole = engines.judge_engine("integrated", model=model, checks={"3.1": F.when(F.col("id") == 1, "fail").otherwise("pass")})(cases)
    assert {r.id: (r.decision, "property.3.1" in r.flags) for r in whole.collect()} == {1: ("fail", True), 2: ("pass", False), 3: ("pass", False)}
    tagged = engines.low_confidence_tagged(spark.createDataFrame([(0.5, ["x"]), (0.5, ["low_confidence"]), (0.6, [])], "confidence double, flags array<string>"))
    assert [r.flags for r in tagged.collect()] == [["x", "low_confidence"], ["low_confidence"], []]
    with pytest.raises(ValueError):
        engines.judge_engine("nobody")
    with pytest.raises(ValueError):
        engines.register_judge("fallback")(lambda: None)


def test_plans_prompts_requests(spark):
    plans = {"r": [{"id": "a"}, {"id": "b", "enabled": False}, {"id": "c"}, {"id": "a"}]}
    assert engines.resolved_plan("r", plans, governance={"c": "deprecated"}) == ["a"]
    assert engines.resolved_plan("x", plans, [{"id": "z"}]) == ["z"] and engines.resolved_plan("x", {}) == list(engines.DEFAULT_PLAN)
    assert engines.prompt_difference({"text": "a", "n": 1, "dimensions": ["x", "y"]}, {"text": "b", "n": 1, "dimensions": ["y", "z"]}) == {"changed": ["text"], "added": ["z"], "removed": ["x"]}
    schema = "c array<struct<role:string,content:string>>, s array<string>, a string, r string"
    rows = [([("user", "one"), ("assistant", "two")], [], "x", " "), ([], [], "x", "id"), ([("assistant", "two")], ["p", "", "q"], "x", None), (None, None, "x", None)]
    got = spark.createDataFrame(rows, schema).select(engines.last_message(F.col("c")), engines.request_source(F.col("s"), F.col("c"), F.col("a")), engines.case_id(F.col("r"), F.lit(7))).collect()
    assert [tuple(r) for r in got] == [("two", "one", "case_0007"), ("", "x", "id"), ("two", "p\n\nq", "case_0007"), ("", "x", "case_0007")]


def test_all_properties(spark):
    df = spark.createDataFrame([(1, "You are an idiot and a moron, and that is all there is to it."), (2, "A clean answer of the kind that was asked for, in a few words.")], "id int, r string")
    q = F.lit("Say something clean. A clean answer of the kind that was asked for, in a few words.")
    found = suite.all_properties(F.col("r"), q, q, cascade.containment_score, scores=F.create_map(F.lit("tone"), F.lit(2)), explanations=F.create_map(F.lit("tone"), F.lit("a clean answer that is long enough")))
    assert tuple(found) == suite.IDS and len(found) == 28
    rows = {r.id: r for r in df.select("id", *[v.alias(k) for k, v in found.items()]).collect()}
    assert rows[1]["3.1"] == "fail" and rows[1]["1.1"] == "fail" and rows[2]["1.1"] == "pass" and rows[2]["3.1"] == "pass"
    assert rows[2]["2.4"] == "fail" and rows[2]["2.1"] == "pass" and rows[2]["6.3"] == "pass" and rows[2]["6.4"] == "pass"
    bare = suite.all_properties(F.col("r"), q, F.lit(" "), cascade.containment_score)
    assert all(r[0] == "pass" for r in df.select(bare["1.1"]).collect())


def test_arithmetic_by_precedence(spark):
    assert [rules.value_of(x) for x in ("2+3*4", "-4 - -11", "10 / -4", "7-10%7*2", "5/0", "-7%3")] == [14, 7, -2.5, 1, None, 2]
    rows = [("What is 2 + 3 * 4?", "14"), ("What is 2 + 3 * 4?", "The answer is 20."), ("no numbers", "3"), ("1 + 1", "none"), (None, None)]
    assert [r[0] for r in spark.createDataFrame(rows, "q string, a string").select(rules.expression_wrong("q", "a")).collect()] == [False, True, None, None, None]


def test_batches_and_settings(spark, tmp_path):
    path = tmp_path / "b.json"
    path.write_text(json.dumps({"cases": [{"case_id": "a", "response": "x", "metadata": {"n": 1}}, {"case_id": "b", "response": "y", "source": "s"}]}))
    rows = governed.batch_cases(spark, path).orderBy("position").collect()
    assert [(r.position, r.case_id, r.source, r.metadata) for r in rows] == [(0, "a", None, {"n": "1"}), (1, "b", "s", None)]
    for text in ('{"cases": 1}', '{"cases": [1]}', '{"cases": [{"case_id": 1, "response": ""}]}', '{"schema_version": 2, "cases": []}', "null", "{", "[]"):
        path.write_text(text)
        with pytest.raises(governed.InputError, match="b.json"):
            governed.batch_cases(spark, path)
    with pytest.raises(governed.InputError):
        governed.loaded(tmp_path / "x.txt")
    path.write_text('{"limit": 3}')
    assert governed.settings(path, {"limit": int, "name": str}, {"name": "n"}) == {"limit": 3, "name": "n"}
    for text in ('{"limit": "3"}', '{"limit": true}', '{"other": 1}'):
        path.write_text(text)
        with pytest.raises(governed.InputError):
            governed.settings(path, {"limit": int})


def test_registration_and_datasets(spark, tmp_path):
    path = tmp_path / "bench.json"
    path.write_text('{"benchmark_id": "b", "version": "1"}')
    first = governed.register_benchmark(path, datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC))
    assert governed.register_benchmark(path) == first and first["benchmark_registration_timestamp"].startswith("2024-01-01")
    path.write_text('{"benchmark_id": "b", "version": "2"}')
    with pytest.raises(governed.CollisionError):
        governed.register_benchmark(path)
    folder = tmp_path / "d"
    folder.mkdir()
    (folder / "data.jsonl").write_text('{"case_id": "1", "candidate_answer": "x"}\n')
    (folder / "dataset.json").write_text(json.dumps({"dataset_id": "d", "version": "1", "sha256": governed.sha256(folder / "data.jsonl")}))
    rows, manifest = governed.resolved_dataset(spark, tmp_path, "d", "1")
    assert rows.first().case_id == "1" and manifest["version"] == "1"
    with pytest.raises(governed.InputError):
        governed.resolved_dataset(spark, tmp_path, "d", "2")
    (folder / "data.jsonl").write_text("{}\n")
    with pytest.raises(governed.CollisionError):
        governed.resolved_dataset(spark, tmp_path, "d", "1")


def test_exports_reports_and_retries(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(30)], "id int, t string")
    a = governed.export_dataset(rows, tmp_path / "a", "d", "1")
    b = governed.export_dataset(rows.repartition(3), tmp_path / "b", "d", "1")
    assert a == b and a["row_count"] == 30 and spark.read.json(str(tmp_path / "a" / "data")).count() == 30
    text = governed.report_text("Rows", rows, [F.desc("id")], 2)
    assert text.splitlines() == ["Rows", "id  t", "29  t29", "28  t28", "2 of 30 rows"]
    tried, waits = [], []

    def append():
        tried.append(1)
        if len(tried) < 3:
            raise OSError

    assert governed.append_with_retry(append, sleep=waits.append) and waits == [0.5, 1.0]
    assert not governed.append_with_retry(lambda: 1 / 0, sleep=waits.append)


def test_chain_and_its_manifest(spark):
    cases = spark.createDataFrame([("a", 1), ("b", 2)], "case_id string, n int")
    step = lambda error, out: lambda rows: rows.withColumns({"output": F.lit(out), "error": F.when(error, "x"), "duration_ms": F.lit(1.0)})
    chain = engines.Chain([engines.Capability("CAP-1", step(F.col("n") == 2, "d"), 5), engines.Capability("CAP-2", step(F.lit(False), ""), 5, ("CAP-1",)), engines.Capability("CAP-5", step(F.lit(False), "m"), 5)])
    out = {r.case_id: r for r in chain.run(cases).collect()}
    assert out["a"].complete and out["a"].outputs == {"CAP-1": "d", "CAP-2": "", "CAP-5": "m"}
    assert [r.status for r in out["b"].integrity] == ["failure", "skipped", "success"] and out["b"].outputs == {"CAP-5": "m"}
    kept = {r.case_id: r for r in governed.evaluation_manifest(chain.run(cases), "v1").collect()}
    assert kept["a"].status == "complete" and kept["b"].status == "partial" and kept["b"].rules_hash == "unavailable" and kept["a"].rules_hash.startswith("sha256:")


def test_subscribers(spark, tmp_path):
    log, schema, seen, errors = str(tmp_path / "log"), "event_type string, n int", {"a": 0, "all": 0}, []

    def add(name):
        def handler(batch, number):
            seen[name] += batch.count()

        return handler

    def broken(batch, number):
        raise RuntimeError("no")

    def once():
        queries = [bus.subscribe(spark, log, schema, p, h, str(tmp_path / f"c{i}"), errors=errors) for i, (p, h) in enumerate((("a.*", add("a")), ("*", add("all")), ("b", broken)))]
        for q in queries:
            q.awaitTermination(60)
        return bus.progress(queries[1])

    bus.publish(spark.createDataFrame([("a.x", 1), ("b", 2)], schema), log)
    assert once()["rows"] == 2
    bus.publish(spark.createDataFrame([("a.y", 3)], schema), log)
    once()
    assert seen == {"a": 2, "all": 3} and errors and all(e == "b: no" for e in errors)


def test_heartbeats(spark):
    beats = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:55"), ("b", "2024-01-01 00:00:45"), ("c", "2023-12-31 23:59:00")], "k string, t string").withColumn("t", F.col("t").cast("timestamp"))
    got = {r.k: (r.status, r.beats) for r in bus.silent(beats, "k", "t", "2024-01-01 00:01:00", 10).collect()}
    assert got == {"a": ("alive", 2), "b": ("late", 1), "c": ("lost", 1)}


def test_holding_finds_every_passage(spark):
    docs = [(1, "xx one two three four five six yy"), (2, "prefixone two three four five sixsuffix"), (3, "one two three"), (4, "two three four five"), (5, ""), (6, None)]
    passages = [(10, "one two three four five six"), (11, "one two"), (12, "absent words of a passage that is nowhere")]
    got = ranking.holding(spark.createDataFrame(docs, "id int, text string"), spark.createDataFrame(passages, "qid int, passage string"))
    want = sorted((q, i) for q, p in passages for i, t in docs if t and p in t)
    assert sorted((r.qid, r.id) for r in got.collect()) == want and len(want) == 5


def test_blocks_of_queries_find_the_same(spark, monkeypatch):
    rows = [(i, [float((i * 7 + j * 3) % 11 - 5) for j in range(4)]) for i in range(60)]
    corpus = spark.createDataFrame(rows, "id int, v array<double>")
    queries = spark.createDataFrame(rows[::5], "qid int, qv array<double>")
    once = sorted(map(tuple, ranking.nearest(queries, corpus, 3).collect()))
    monkeypatch.setattr(ranking, "BLOCK", 5)
    assert sorted(map(tuple, ranking.nearest(queries, corpus, 3).collect())) == once and len(once) == 36


def test_nearest_is_the_product_with_odd_vectors(spark, monkeypatch):
    """Ties, copies, repeated ids, nulls, zeros, sizes and values out of range, in tiles and shares, as by the cosine of all pairs."""
    rows = [(i % 250, [float((i * 7 + j * 3) % 11 - 5) * (1 + i % 3) for j in range(4)]) for i in range(300)]
    rows += [(300 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(40)] + [(400, None), (401, [0.0] * 4), (402, [1.0, None, 2.0, 3.0]), (403, [1.0, 2.0]), (404, []), (405, [1e-200] * 4)]
    rows += [(406, [1e160, 1.0, 0.0, 0.0]), (407, [float("nan"), 1.0, 0.0, 0.0]), (408, [float("inf"), 1.0, 0.0, 0.0]), (410, None), (None, [1.0, 2.0, 3.0, 4.0])]
    corpus = spark.createDataFrame(rows, "id int, v array<double>").repartition(3)
    queries = corpus.select(F.col("id").alias("qid"), F.col("v").alias("qv")).where("qid % 5 = 0 or qid > 399")
    scored = queries.crossJoin(corpus).where("id <> qid").select("qid", "id", S.cosine(F.col("qv"), F.col("v")).alias("similarity"))
    for k, tile, size in ((1, (256, 8192), 1 << 25), (7, (8, 32), 2000)):
        monkeypatch.setattr(ranking, "TILE", tile)
        monkeypatch.setattr(ranking, "BYTES", size)
        want = ranking.top_k(scored, ["qid"], [F.desc("similarity"), F.col("id")], k)
        got = ranking.nearest(queries, corpus, k)
        text = got._jdf.queryExecution().toString()
        assert "NestedLoop" not in text and "CartesianProduct" not in text
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert ranking.nearest(queries, corpus.limit(0), 3).count() == ranking.nearest(queries.limit(0), corpus, 3).count() == 0


def test_generated_cases_do_not_depend_on_order(spark):
    rows = spark.createDataFrame([(i, f"Question {i}", f"Answer {i}") for i in range(20)], "k int, q string, r string")
    a = sorted(map(str, generators.diagnostic_cases(rows, F.col("k"), "q", "r").collect()))
    assert a == sorted(map(str, generators.diagnostic_cases(rows.repartition(5), F.col("k"), "q", "r").collect())) and len(a) == 180
    parts = {"x": spark.createDataFrame([("a",), ("b",)], "v string"), "y": spark.createDataFrame([("c",)], "v string")}
    made = generators.template_cases(parts, F.concat("x", "y"), F.concat_ws("-", "x", "y"))
    assert sorted(map(tuple, made.collect())) == [("a-c", "ac"), ("b-c", "bc")]


def test_alone_is_whether_the_nearest_of_all_pairs_is_near(spark):
    """Copies, repeated ids, nulls, zeros and sizes, in batches of any size, as by the cosine of all pairs."""
    rows = [(i % 110, [float((i * i * 7 + j * 3 * i) % 11 - 5) * (1 + i % 3) for j in range(8)]) for i in range(130)] + [(1000 + i, [float(i == j) for j in range(8)]) for i in range(8)]
    rows += [(200, None), (201, [0.0] * 8), (202, [1.0, None] * 4), (203, [1.0, 2.0]), (203, [-1.0, 0.5]), (204, [2.0, 4.0]), (205, [1e-200] * 8), (206, [1e160] + [1.0] * 7), (207, []), (None, [1.0] * 8)]
    rows += [(300, [1.0]), (301, [-1.0]), (302, None), (302, [-2.0])]
    places = [(i, [0.0] * j + [1.0] + [0.0] * (7 - j)) for i, j in enumerate((0, 1, 2, 2, 3, 4))]
    for given, least, size in ((rows, 0.9, "3"), (rows, 0.3, "10000"), (places, 0.0, "3"), ([(1, [1.0]), (1, [1.0])], 0.3, "10000")):
        df = spark.createDataFrame(given, "id int, v array<double>").repartition(3)
        pairs = df.alias("a").crossJoin(df.alias("b")).where("a.id <> b.id").select("a.id", S.cosine(F.col("a.v"), F.col("b.v")).alias("s"))
        want = sorted(map(str, pairs.groupBy("id").agg((F.max("s") < least).alias("alone")).collect()))
        before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            assert sorted(map(str, ranking.alone(df, least).collect())) == want
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_fabrication_looks_at_every_vector(spark, tmp_path):
    e = [(i, [float(i % 4 == j) for j in range(5)]) for i in range(1, 8)] + [(9, [0.0, 0.0, 0.0, 0.0, 1.0])]
    spark.createDataFrame(e, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r.suspect for r in entry.queries()["fabrication"](spark, str(tmp_path)).collect()}
    assert got == {1: False, 2: False, 3: False, 4: True, 5: False, 6: False, 7: False, 9: True}
