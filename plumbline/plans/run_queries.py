"""Run analytics: diffs, policies, drift, trends, samples, logs and governance over the tables in their roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog import query
from plumbline.functions import stats as S
from plumbline.operators import diffing, drift, logs, ranking, robustness
from plumbline.plans.base import GOVERNANCE, governance_events, human_labels, pairs, ratio, table

# Two runs over documents: one without a source, the other without another, by different rules.
_RUN = """base AS (SELECT doc_id, CASE WHEN n_chars % 5 = 0 THEN 'fail' ELSE 'pass' END AS decision, (1 + n_chars % 5)::BIGINT AS clarity, (1 + n_chars % 3)::BIGINT AS tone,
    CASE WHEN n_chars % 4 = 0 THEN ['short', 'plain'] WHEN n_chars % 4 = 1 THEN ['plain'] END AS flags FROM documents WHERE source <> 'src3'),
  cand AS (SELECT doc_id, CASE WHEN n_chars % 7 = 0 THEN 'fail' ELSE 'pass' END AS decision, (1 + n_chars % 6)::BIGINT AS clarity, (1 + n_chars % 3)::BIGINT AS tone,
    CASE WHEN n_chars % 6 = 0 THEN ['new', 'plain'] ELSE [] END AS flags FROM documents WHERE source <> 'src5')"""


def runs(spark, d):
    n = F.col("n_chars")
    none = F.lit(None).cast("array<string>")
    both = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    base = both.where("source <> 'src3'").select(
        "doc_id", F.when(n % 5 == 0, "fail").otherwise("pass").alias("decision"), (1 + n % 5).alias("clarity"), (1 + n % 3).alias("tone"),
        F.when(n % 4 == 0, F.array(F.lit("short"), F.lit("plain"))).when(n % 4 == 1, F.array(F.lit("plain"))).otherwise(none).alias("flags"), "doc_id",
    )
    cand = both.where("source <> 'src5'").select(
        "doc_id", F.when(n % 7 == 0, "fail").otherwise("pass").alias("decision"), (1 + n % 6).alias("clarity"), (1 + n % 3).alias("tone"),
        F.when(n % 6 == 0, F.array(F.lit("new"), F.lit("plain"))).otherwise(F.array().cast("array<string>")).alias("flags"),
    )
    base = base.toDF("doc_id", "decision", "clarity", "tone", "flags", "seq")
    return diffing.pair(base, cand.withColumn("seq", F.col("doc_id")), ["doc_id"], "seq")


@query("run_diff_missing", f"WITH {_RUN} SELECT (SELECT count(*) FROM base ANTI JOIN cand USING (doc_id)) AS missing, (SELECT count(*) FROM cand ANTI JOIN base USING (doc_id)) AS new, (SELECT count(*) FROM base JOIN cand USING (doc_id)) AS common")
def _(spark, d):
    return diffing.presence(runs(spark, d))


@query("run_diff_flips", f"WITH {_RUN} SELECT doc_id, b.decision AS base_decision, c.decision AS cand_decision FROM base b JOIN cand c USING (doc_id) WHERE b.decision <> c.decision")
def _(spark, d):
    return diffing.flips(runs(spark, d), ["doc_id"])


@query("run_diff_scores", f"WITH {_RUN}, j AS (SELECT doc_id, c.clarity - b.clarity AS clarity, c.tone - b.tone AS tone FROM base b JOIN cand c USING (doc_id)) SELECT doc_id, 'clarity' AS dimension, clarity AS delta FROM j WHERE clarity <> 0 UNION ALL SELECT doc_id, 'tone', tone FROM j WHERE tone <> 0")
def _(spark, d):
    return diffing.score_deltas(runs(spark, d), ["doc_id"], ("clarity", "tone"))


@query(
    "run_diff_flags",
    f"""WITH {_RUN}, j AS (SELECT doc_id, coalesce(b.flags, []) AS b, coalesce(c.flags, []) AS c FROM base b JOIN cand c USING (doc_id)),
  k AS (SELECT doc_id, list_sort(list_filter(c, lambda x: NOT list_contains(b, x))) AS a, list_sort(list_filter(b, lambda x: NOT list_contains(c, x))) AS r FROM j)
  SELECT doc_id, array_to_string(a, ',') AS added, array_to_string(r, ',') AS removed FROM k WHERE len(a) > 0 OR len(r) > 0""",
)
def _(spark, d):
    rows = diffing.flag_changes(runs(spark, d), ["doc_id"])
    return rows.select("doc_id", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"))


_WIDE = "b AS (SELECT count(*)::DOUBLE AS cases, avg(clarity)::DOUBLE AS clarity, (count(*) FILTER (decision = 'pass'))::DOUBLE / count(*) AS pass_rate FROM base), c AS (SELECT count(*)::DOUBLE AS cases, (count(*) FILTER (decision = 'pass'))::DOUBLE / count(*) AS pass_rate, avg(tone)::DOUBLE AS tone FROM cand)"
_DIFF = f"{_RUN}, {_WIDE}, lb AS (SELECT 'cases' AS metric, cases AS v FROM b UNION ALL SELECT 'clarity', clarity FROM b UNION ALL SELECT 'pass_rate', pass_rate FROM b), lc AS (SELECT 'cases' AS metric, cases AS v FROM c UNION ALL SELECT 'pass_rate', pass_rate FROM c UNION ALL SELECT 'tone', tone FROM c), diff AS (SELECT coalesce(lb.metric, lc.metric) AS metric, lb.v AS base, lc.v AS cand, lc.v - lb.v AS delta, CASE WHEN lc.metric IS NULL THEN 'only_in_baseline' WHEN lb.metric IS NULL THEN 'only_in_candidate' ELSE 'both' END AS status FROM lb FULL JOIN lc ON lb.metric = lc.metric)"


def run_metrics(spark, d):
    p = runs(spark, d)
    side = lambda s, *extra: p.where(F.col(s).isNotNull()).agg(F.count(F.lit(1)).cast("double").alias("cases"), S.ratio(F.count_if(F.col(f"{s}.decision") == "pass"), F.count(F.lit(1))).alias("pass_rate"), *extra)
    base = side("base", F.avg("base.clarity").alias("clarity"))
    cand = side("cand", F.avg("cand.tone").alias("tone"))
    return diffing.metric_diff(diffing.long_metrics(base, ["cases", "clarity", "pass_rate"]), diffing.long_metrics(cand, ["cases", "pass_rate", "tone"]))


@query("metric_diff", f"WITH {_DIFF} SELECT * FROM diff")
def _(spark, d):
    return run_metrics(spark, d)


@query("policy_violations", f"WITH {_DIFF}, p AS (SELECT * FROM (VALUES ('cases', 0.0), ('clarity', 0.1), ('pass_rate', 0.0), ('absent', 0.0)) t(metric, tol)) SELECT metric, CASE WHEN (base IS NULL) <> (cand IS NULL) THEN 'missing' WHEN base - cand > tol THEN 'drop' END AS kind FROM p JOIN diff USING (metric) WHERE (base IS NULL) <> (cand IS NULL) OR base - cand > tol")
def _(spark, d):
    return diffing.violations(run_metrics(spark, d), {"cases": 0.0, "clarity": 0.1, "pass_rate": 0.0, "absent": 0.0})


@query("promotion_gate", f"WITH {_DIFF}, f AS (SELECT count(*) AS flips FROM base b JOIN cand c USING (doc_id) WHERE b.decision <> c.decision) SELECT flips, (SELECT bool_and(delta IS NOT NULL AND delta >= -0.01) FROM diff WHERE metric IN ('pass_rate', 'cases')) AS metrics_ok, flips <= 0 AS flips_ok FROM f")
def _(spark, d):
    ok = run_metrics(spark, d).where(F.col("metric").isin("pass_rate", "cases")).agg(F.bool_and(F.coalesce(F.col("delta") >= -0.01, F.lit(False))).alias("metrics_ok"))
    flipped = diffing.flips(runs(spark, d), ["doc_id"]).agg(F.count(F.lit(1)).alias("flips"))
    return flipped.crossJoin(F.broadcast(ok)).select("flips", "metrics_ok", (F.col("flips") <= 0).alias("flips_ok"))


# Runs of every day: a metric for each event type, from exact counts.
_DAILY = "daily AS (SELECT CAST(ts AS DATE)::VARCHAR AS run_id, event_type AS metric, (count(*) FILTER (value > 50))::DOUBLE / count(*) AS value FROM events GROUP BY 1, 2)"


def daily(spark, d):
    n = F.count(F.lit(1))
    return table(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("run_id"), F.col("event_type").alias("metric")).agg(S.ratio(F.count_if(F.col("value") > 50), n).alias("value"))


_TREND = "t AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY run_id DESC, value DESC) AS n FROM daily), e AS (SELECT metric, min_by(value, run_id) AS oldest, max_by(value, run_id) AS newest, count(*) AS c FROM t WHERE n <= 7 GROUP BY metric)"


@query("drift_trend", f"WITH {_DAILY}, {_TREND} SELECT metric, oldest, newest, newest - oldest AS delta, newest - oldest >= -0.05 AS ok FROM e WHERE c >= 2")
def _(spark, d):
    return drift.trend(daily(spark, d), 7, 0.05)


@query(
    "drift_point",
    f"""WITH {_DAILY}, r AS (SELECT metric, max_by(value, run_id) AS cand, min_by(value, run_id) AS base FROM daily GROUP BY metric),
  p AS (SELECT * FROM (VALUES ('error', 0.1, 0.05), ('click', NULL, 0.0), ('absent', NULL, 0.0)) t(metric, least, tol)), j AS (SELECT p.metric, least, tol, base, cand FROM p LEFT JOIN r ON p.metric = r.metric)
  SELECT metric, 'present' AS "check", base IS NOT NULL AND cand IS NOT NULL AS ok FROM j UNION ALL SELECT metric, 'least', cand >= least FROM j WHERE base IS NOT NULL AND least IS NOT NULL UNION ALL SELECT metric, 'drop', cand - base >= -tol FROM j WHERE base IS NOT NULL AND tol IS NOT NULL""",
)
def _(spark, d):
    ends = daily(spark, d).groupBy("metric").agg(F.max_by("value", "run_id").alias("c"), F.min_by("value", "run_id").alias("b"))
    policy = spark.createDataFrame([("error", 0.1, 0.05), ("click", None, 0.0), ("absent", None, 0.0)], "metric string, least double, tolerance double")
    return drift.point(ends.select("metric", F.col("c").alias("value")), ends.select("metric", F.col("b").alias("value")), policy)


@query("registry_trend", f"WITH {_DAILY}, t AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY run_id DESC, value DESC) AS n FROM daily) SELECT metric, run_id, value, value - lag(value) OVER (PARTITION BY metric ORDER BY run_id) AS delta FROM t WHERE n <= 10")
def _(spark, d):
    from pyspark.sql import Window

    last = drift.newest(daily(spark, d), 10, ["metric"], "run_id", "value")
    return last.select("metric", "run_id", "value", (F.col("value") - F.lag("value").over(Window.partitionBy("metric").orderBy("run_id"))).alias("delta"))


@query("registry_list", f"WITH {_DAILY} SELECT run_id, metric, value FROM daily WHERE metric = 'error' ORDER BY run_id DESC LIMIT 10")
def _(spark, d):
    return daily(spark, d).where("metric = 'error'").select("run_id", "metric", "value").orderBy(F.desc("run_id")).limit(10)


@query("registry_show", f"WITH {_DAILY} SELECT run_id, metric, value FROM daily WHERE run_id = '2024-01-05' AND metric = 'view'")
def _(spark, d):
    return daily(spark, d).where("run_id = '2024-01-05' and metric = 'view'").select("run_id", "metric", "value")


@query("latest_version", f"WITH {_DAILY} SELECT metric, max(run_id) AS latest FROM daily GROUP BY metric")
def _(spark, d):
    return daily(spark, d).groupBy("metric").agg(F.max("run_id").alias("latest"))


@query("stable_sample", "SELECT doc_id FROM documents ORDER BY substr(sha256('7:' || doc_id::VARCHAR), 1, 16), doc_id LIMIT 50")
def _(spark, d):
    return ranking.stable_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 50, "7")


@query("stable_sample_key", "SELECT doc_id FROM documents ORDER BY substr(sha256(doc_id::VARCHAR), 1, 12), doc_id LIMIT 50")
def _(spark, d):
    return ranking.stable_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 50, None, 12)


@query("sample_head", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 50")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id").orderBy("doc_id").limit(50)


@query("per_group_sample", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY substr(sha256('3:' || doc_id::VARCHAR), 1, 16), doc_id) AS n FROM documents) WHERE n <= 5")
def _(spark, d):
    return ranking.per_group_sample(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 5, "3")


@query("smoke_gate", "SELECT (count(*) FILTER (ok))::DOUBLE / count(*)::DOUBLE AS rate, (count(*) FILTER (ok))::DOUBLE / count(*)::DOUBLE >= 0.5 AS go FROM (SELECT quality = 1 AND toxic = 0 AS ok FROM labels ORDER BY doc_id LIMIT 20)")
def _(spark, d):
    first = human_labels(spark, d).orderBy("doc_id").limit(20)
    rate = S.ratio(F.count_if(F.col("human_decision") == "pass"), F.count(F.lit(1)))
    return first.agg(rate.alias("rate"), (rate >= 0.5).alias("go"))


# Logs
@query("scan_filter", "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' AND value > 100")
def _(spark, d):
    return table(spark, d, "events").where("event_type = 'purchase' and value > 100").select("event_id", "user_id", "value")


@query("events_parse_props", f"WITH {GOVERNANCE} SELECT event_id, k FROM gov WHERE k IS NOT NULL")
def _(spark, d):
    return governance_events(spark, d).where("k is not null").select("event_id", "k")


@query("event_query", f"WITH {GOVERNANCE} SELECT event_id, actor FROM gov WHERE type = 'rule_change' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-12'")
def _(spark, d):
    at = lambda s: F.lit(s).cast("timestamp")
    return logs.query_events(governance_events(spark, d), kind="rule_change", since=at("2024-01-05"), until=at("2024-01-12"), key="user").select("event_id", "actor")


@query("event_trace", f"WITH {GOVERNANCE} SELECT event_id, type FROM gov WHERE k = 42")
def _(spark, d):
    return logs.query_events(governance_events(spark, d), key="k", value="42").select("event_id", "type")


_NEAR = f"""{GOVERNANCE}, al AS (SELECT event_id AS alert_id, ts AS alert_ts FROM gov WHERE type = 'drift_alert' AND value > 150), ch AS (SELECT event_id, ts, type FROM gov WHERE type = 'rule_change'),
  nr AS (SELECT alert_id, event_id, (epoch_us(ts) - epoch_us(alert_ts))::BIGINT AS micros FROM al JOIN ch ON ts BETWEEN alert_ts - INTERVAL 24 HOUR AND alert_ts + INTERVAL 24 HOUR),
  rk AS (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY abs(micros), event_id) AS rank FROM nr)"""


def correlated(spark, d):
    g = governance_events(spark, d)
    alerts = g.where("type = 'drift_alert' and value > 150").select(F.col("event_id").alias("alert_id"), F.col("ts").alias("alert_ts"))
    return drift.correlate(alerts, g.where("type = 'rule_change'").select("event_id", "ts"), 24, 10)


@query("event_correlation", f"WITH {_NEAR} SELECT alert_id, event_id, micros, rank FROM rk WHERE rank <= 10")
def _(spark, d):
    return correlated(spark, d).select("alert_id", "event_id", "micros", F.col("rank").cast("long").alias("rank"))


@query("drift_causation", f"WITH {_NEAR} SELECT alert_id, event_id, CASE WHEN micros < 0 THEN 'before' ELSE 'after' END AS position, CASE WHEN abs(micros) < 7200000000 THEN 'high' WHEN abs(micros) < 43200000000 THEN 'medium' ELSE 'low' END AS confidence FROM rk WHERE rank <= 10")
def _(spark, d):
    position, confidence = drift.causation(F.col("micros"))
    return correlated(spark, d).select("alert_id", "event_id", position.alias("position"), confidence.alias("confidence"))


@query("drift_response", "SELECT event_id, CASE event_type WHEN 'error' THEN 'block' WHEN 'click' THEN 'warn' WHEN 'view' THEN 'warn' ELSE 'log' END AS action FROM events")
def _(spark, d):
    message = F.concat(F.lit("drop of "), F.col("event_type"), F.lit(" rate"))
    return table(spark, d, "events").select("event_id", drift.response(message, {"error": "block", "click": "warn", "view": "page"}).alias("action"))


@query("heartbeat", f"WITH {GOVERNANCE} SELECT max(ts) AS last, epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(ts)) <= 72 * 3600000000 AS ok FROM gov WHERE type = 'eval_run'")
def _(spark, d):
    return drift.heartbeat(governance_events(spark, d), F.lit("2024-02-01").cast("timestamp"), 72)


@query("capability_rollup", "SELECT event_type AS capability, count(*) AS n, (count(*) FILTER (value <= 200))::DOUBLE / count(*)::DOUBLE AS success_rate, sum(CAST(round(value * 100) AS BIGINT))::DOUBLE / count(*)::DOUBLE AS mean_ms, quantile_cont(CAST(round(value * 100) AS BIGINT)::DOUBLE, 0.95) AS p95_ms FROM events GROUP BY 1")
def _(spark, d):
    cents = F.round(F.col("value") * 100).cast("long")
    return logs.capability_rollup(table(spark, d, "events").withColumn("cents", cents), "event_type", F.col("value") <= 200, F.col("cents")).withColumnRenamed("event_type", "capability")


@query("duration_percentiles", "SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99 FROM events GROUP BY 1")
def _(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(*[S.pct(F.col("value"), p / 100).alias(f"p{p}") for p in (50, 95, 99)])


_SUB = "s AS (SELECT user_id % 7 AS cap, CASE event_type WHEN 'click' THEN 'started' WHEN 'view' THEN 'started' WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'skipped' END AS status, value > 30 AS success FROM events)"


@query("subcap_rollup", f"WITH {_SUB} SELECT cap, count(*) FILTER (status = 'started') AS fired, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'skipped') AS skipped, {ratio('count(*) FILTER (status = ' + chr(39) + 'completed' + chr(39) + ' AND success)', 'count(*) FILTER (status = ' + chr(39) + 'started' + chr(39) + ')')} AS success_rate FROM s GROUP BY cap")
def _(spark, d):
    e = F.col("event_type")
    status = F.when(e.isin("click", "view"), "started").when(e == "purchase", "completed").when(e == "signup", "skipped")
    return logs.subcapability_rollup(table(spark, d, "events").select((F.col("user_id") % 7).alias("cap"), status.alias("status"), (F.col("value") > 30).alias("success")), ["cap"])


@query("horizontal_engagement", "SELECT t.event_type, count(event_id) AS n FROM (VALUES ('click'), ('error'), ('never')) t(event_type) LEFT JOIN events USING (event_type) GROUP BY 1")
def _(spark, d):
    return logs.engagement(table(spark, d, "events"), "event_type", ["click", "error", "never"])


@query("batch_outcomes", "SELECT CASE WHEN event_type = 'error' THEN 'error' WHEN value > 100 THEN 'failure' ELSE 'success' END AS outcome, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    return logs.outcomes(table(spark, d, "events"), F.col("event_type") == "error", F.col("value") > 100)


_STATES = "st AS (SELECT user_id, max_by(event_type, event_id) AS e, max_by(value, event_id) AS v FROM events GROUP BY user_id), qs AS (SELECT user_id, CASE WHEN e IN ('click', 'view') THEN 'pending' WHEN e = 'signup' THEN 'claimed' ELSE 'resolved' END AS state, v FROM st)"


def states(spark, d):
    last = logs.latest(table(spark, d, "events"), "user_id", "event_id", ["event_type", "value"])
    e = F.col("event_type")
    return last.select("user_id", F.when(e.isin("click", "view"), "pending").when(e == "signup", "claimed").otherwise("resolved").alias("state"), "value")


@query("latest_state", f"WITH {_STATES} SELECT user_id, state, v AS value FROM qs")
def _(spark, d):
    return states(spark, d)


@query("queue_stats", f"WITH {_STATES} SELECT count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'claimed') AS claimed, count(*) FILTER (state = 'resolved') AS resolved, (count(*) FILTER (state = 'resolved' AND (v > 20) = (user_id % 2 = 0)))::DOUBLE / nullif(count(*) FILTER (state = 'resolved'), 0)::DOUBLE AS agreement FROM qs")
def _(spark, d):
    return logs.queue_stats(states(spark, d).withColumns({"judge": F.col("value") > 20, "human": F.col("user_id") % 2 == 0}))


_HISTORY = "h AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'detected' WHEN 'view' THEN 'triaged' WHEN 'purchase' THEN 'responding' ELSE 'resolved' END AS s FROM events), l AS (SELECT user_id, event_id, lag(s) OVER (PARTITION BY user_id ORDER BY event_id) AS f, s FROM h)"


@query("issue_transitions", f"WITH {_HISTORY} SELECT user_id, event_id, f AS \"from\", s AS \"to\" FROM l WHERE NOT coalesce((f IS NULL AND s = 'detected') OR (f = 'detected' AND s IN ('triaged', 'resolved')) OR (f = 'triaged' AND s IN ('responding', 'resolved')) OR (f = 'responding' AND s IN ('resolved', 'triaged')), false)")
def _(spark, d):
    e = F.col("event_type")
    state = F.when(e == "click", "detected").when(e == "view", "triaged").when(e == "purchase", "responding").otherwise("resolved")
    return drift.invalid_transitions(table(spark, d, "events").select("user_id", "event_id", state.alias("s")), "user_id", "event_id", "s")


@query("governance_drift", "SELECT n_name AS key, 'ungoverned' AS problem FROM nation WHERE n_regionkey < 3 AND n_name NOT IN (SELECT n_name FROM nation WHERE n_nationkey % 2 = 0) UNION ALL SELECT n_name, 'stale' FROM nation WHERE n_nationkey % 2 = 0 AND n_regionkey >= 3")
def _(spark, d):
    nation = table(spark, d, "nation").withColumnRenamed("n_name", "key")
    return logs.governance_drift(nation.where("n_regionkey < 3"), nation.where("n_nationkey % 2 = 0"), "key")


@query("rule_aging", "SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-01-01')::BIGINT AS days, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-01-01') > 365 AS stale FROM orders")
def _(spark, d):
    rows = logs.aging(table(spark, d, "orders"), F.to_date("o_orderdate"), F.lit("1998-01-01").cast("date"), 365)
    return rows.select("o_orderkey", F.col("days").cast("long").alias("days"), "stale")


@query("dataset_integrity", "SELECT count(*) AS rows, count(*) FILTER (coalesce(trim(text), '') = '') AS blank_text, count(*) FILTER (coalesce(trim(lang), '') = '') AS blank_lang, (SELECT count(*) FROM (SELECT md5(text) FROM documents GROUP BY 1 HAVING count(*) > 1)) AS repeated_keys FROM documents")
def _(spark, d):
    return logs.integrity(table(spark, d, "documents").withColumn("h", F.md5("text")), "h", ["text", "lang"])


@query("kb_dedup_by_key", "SELECT source, count(DISTINCT md5(text)) AS responses FROM documents WHERE length(text) >= 20 GROUP BY source")
def _(spark, d):
    once = table(spark, d, "documents").where(F.length("text") >= 20).select("source", F.md5("text").alias("h")).distinct()
    return once.groupBy("source").agg(F.count(F.lit(1)).alias("responses"))


@query("cache_missing_sources", "SELECT DISTINCT sha256(text) AS source_hash FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en')")
def _(spark, d):
    docs = table(spark, d, "documents").select(F.sha2("text", 256).alias("source_hash"), "lang")
    return docs.select("source_hash").distinct().join(docs.where("lang = 'en'"), "source_hash", "left_anti")


# Bias
@query("position_bias", "SELECT lang, count(*) AS n, count(*) FILTER (a <> b) AS inconsistent, (count(*) FILTER (a <> b))::DOUBLE / count(*)::DOUBLE AS rate, CASE WHEN (count(*) FILTER (a <> b))::DOUBLE / count(*) < 0.10 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (SELECT lang, length(split_part(text, '.', 1)) > 40 AS a, length(split_part(text, '.', -2)) > 40 AS b FROM documents) GROUP BY lang")
def _(spark, d):
    at = lambda i: F.length(F.split_part("text", F.lit("."), F.lit(i))) > 40
    return robustness.consistency(table(spark, d, "documents").select("lang", at(1).alias("a"), at(-2).alias("b")), "a", "b", ("lang",))


@query("position_bias_scored")
def _(spark, d):
    """Answers scored with the turns before them in original and in reversed order; the tests hold the operator against two scores."""
    opening = table(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("first"))
    return robustness.position_bias(pairs(spark, d).join(opening, "conv_id"))


@query("self_preference", "SELECT count(*) FILTER (own) AS n_own, count(*) FILTER (NOT own) AS n_other, sum(s) FILTER (own)::DOUBLE / count(*) FILTER (own)::DOUBLE - sum(s) FILTER (NOT own)::DOUBLE / count(*) FILTER (NOT own)::DOUBLE AS delta, CASE WHEN abs(sum(s) FILTER (own)::DOUBLE / count(*) FILTER (own)::DOUBLE - sum(s) FILTER (NOT own)::DOUBLE / count(*) FILTER (NOT own)::DOUBLE) > 0.5 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM (SELECT lang = 'en' AS own, 1 + n_chars % 5 AS s FROM documents)")
def _(spark, d):
    return robustness.preference(table(spark, d, "documents"), 1 + F.col("n_chars") % 5, F.col("lang") == "en")


@query("paraphrase_consistency", "SELECT count(*) AS n, count(*) FILTER (a IS DISTINCT FROM b) AS inconsistent, (count(*) FILTER (a IS DISTINCT FROM b))::DOUBLE / count(*)::DOUBLE AS rate, CASE WHEN (count(*) FILTER (a IS DISTINCT FROM b))::DOUBLE / count(*) < 0.10 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (SELECT len(regexp_extract_all(text, '[a-z]+')) > 200 AS a, len(regexp_extract_all(lower(text), '[a-z]+')) > 200 AS b FROM documents)")
def _(spark, d):
    count = lambda c: F.size(F.regexp_extract_all(c, F.lit("[a-z]+"), F.lit(0))) > 200
    return robustness.consistency(table(spark, d, "documents").select(count(F.col("text")).alias("a"), count(F.lower("text")).alias("b")), "a", "b")


@query("majority_vote", "SELECT user_id, count(*) AS votes, count(*) FILTER (value > 20) AS passes, CASE WHEN 2 * count(*) FILTER (value > 20) > count(*) THEN 'pass' ELSE 'fail' END AS decision, sum(k)::DOUBLE / count(*)::DOUBLE AS mean_score, count(*) FILTER (value > 20) BETWEEN 1 AND count(*) - 1 AS disagreement FROM (SELECT user_id, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY user_id")
def _(spark, d):
    rows = governance_events(spark, d)
    return robustness.majority(rows.withColumnRenamed("actor", "user_id"), ["user_id"], F.col("value") > 20, F.col("k"))


@query("property_coverage", "SELECT r_name AS category, count(*) AS total, count(*) FILTER (n_nationkey % 3 <> 0) AS enabled, (count(*) FILTER (n_nationkey % 3 <> 0))::DOUBLE / count(*)::DOUBLE AS coverage FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def _(spark, d):
    n, on = F.count(F.lit(1)), F.count_if(F.col("n_nationkey") % 3 != 0)
    j = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy(F.col("r_name").alias("category")).agg(n.alias("total"), on.alias("enabled"), S.ratio(on, n).alias("coverage"))


@query("confidence_calibration", "SELECT CASE WHEN x < 30 THEN 'low' WHEN x < 70 THEN 'mid' ELSE 'high' END AS bin, count(*) AS n, (count(*) FILTER (value > 20))::DOUBLE / count(*)::DOUBLE AS accuracy FROM (SELECT value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS x FROM events) GROUP BY 1")
def _(spark, d):
    n = F.count(F.lit(1))
    bins = F.when(F.col("k") < 30, "low").when(F.col("k") < 70, "mid").otherwise("high")
    return governance_events(spark, d).groupBy(bins.alias("bin")).agg(n.alias("n"), S.ratio(F.count_if(F.col("value") > 20), n).alias("accuracy"))


@query("label_coverage", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def _(spark, d):
    return table(spark, d, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


