"""Benchmarks as cases, graphs, strategies, model outputs, event windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.catalog import query
from plumbline.functions import stats as S
from plumbline.operators import graphs, grounding, providers, ranking
from plumbline.plans.base import governance_events, pairs, table
from plumbline.sources import benchmarks
from plumbline.streaming import logs as streams


@query("halueval_explode", "SELECT conv_id || '_right' AS case_id, 'pass' AS expected, a AS response FROM (SELECT conv_id::VARCHAR AS conv_id, min_by(text, turn) AS a, max_by(text, turn) AS b FROM conversations GROUP BY 1) UNION ALL SELECT conv_id || '_hallucinated', 'fail', b FROM (SELECT conv_id::VARCHAR AS conv_id, min_by(text, turn) AS a, max_by(text, turn) AS b FROM conversations GROUP BY 1)")
def _(spark, d):
    ends = table(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("a"), F.max_by("text", "turn").alias("b"), F.lit("").alias("q"))
    return benchmarks.right_and_wrong(ends, "conv_id", "q", "q", "a", "b").select("case_id", "expected", "response")


_ANN = "r AS (SELECT doc_id, text, lang, source, CASE WHEN n_chars % 9 = 0 THEN 'truncated' ELSE 'good' END AS quality, n_chars % 4 = 0 AS marked FROM documents), n AS (SELECT CAST(replace(source, 'src', '') AS INTEGER) AS item_id, * FROM r WHERE quality <> 'truncated')"


def annotated(spark, d):
    n = F.col("n_chars")
    span = F.array(F.struct(F.lit(0).alias("start"), F.lit(5).alias("end"), F.lit("conflict").alias("label_type")))
    docs = table(spark, d, "documents")
    responses = docs.select(F.col("doc_id").alias("id"), F.regexp_replace("source", "src", "").cast("long").alias("source_id"), F.col("lang").alias("split"), F.when(n % 9 == 0, "truncated").otherwise("good").alias("quality"), F.col("source").alias("model"), F.col("text").alias("response"), F.when(n % 4 == 0, span).otherwise(F.slice(span, 1, 0)).alias("labels"))
    sources = table(spark, d, "benchmark").select(F.col("item_id").alias("source_id"), F.lit("Summarise.").alias("prompt"), F.col("text").alias("source_info"), F.lit("summary").alias("task_type"))
    return benchmarks.annotated_responses(responses, sources)


@query("benchmark_normalize", f"WITH {_ANN} SELECT doc_id AS case_id, b.text AS context, CASE WHEN marked THEN 'fail' ELSE 'pass' END AS expected FROM n JOIN benchmark b USING (item_id)")
def _(spark, d):
    return annotated(spark, d).select("case_id", "context", "expected")


@query("benchmark_slice", f"WITH {_ANN} SELECT doc_id AS case_id FROM n JOIN benchmark b USING (item_id) WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(spark, d):
    ids = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("case_id"))
    return annotated(spark, d).join(ids, "case_id", "left_semi").select("case_id")


@query("inject_failures", "SELECT doc_id, CASE n_chars % 5 WHEN 1 THEN 'pii' WHEN 2 THEN 'toxic' ELSE 'clean' END AS injection, sha256(text || CASE n_chars % 5 WHEN 1 THEN ' Mail a@b.co.' WHEN 2 THEN ' You fool.' ELSE '' END) AS sha FROM documents")
def _(spark, d):
    rows = benchmarks.inject(table(spark, d, "documents"), "text", {1: "pii: Mail a@b.co.", 2: "toxic: You fool."}, "n_chars", 5)
    return rows.select("doc_id", "injection", F.sha2("text", 256).alias("sha"))


@query("cases_from_documents", r"WITH s AS (SELECT doc_id, unnest(l) AS answer, unnest(range(len(l)))::INT AS pos FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: length(s) > 20) AS l FROM documents)) SELECT doc_id, pos, answer, 'What is said of ' || split_part(answer, ' ', 1) || '?' AS question FROM s WHERE len(string_split_regex(answer, '\s+')) >= 5")
def _(spark, d):
    return benchmarks.questions_from(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "pos", "answer", "question")


_FACT = "f AS (SELECT event_id, user_id, k % 5 AS supported, k % 3 AS contradicted, k % 2 AS shifted FROM (SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"


def facts(spark, d):
    k = F.col("k")
    return governance_events(spark, d).select("event_id", F.col("actor").alias("user_id"), (k % 5).alias("supported"), (k % 3).alias("contradicted"), (k % 2).alias("shifted"))


@query("fact_ratio", f"WITH {_FACT} SELECT event_id, coalesce(supported::DOUBLE / nullif(supported + contradicted + shifted, 0)::DOUBLE, 0.0) AS ratio, coalesce(supported::DOUBLE / nullif(supported + contradicted + shifted, 0)::DOUBLE, 0.0) >= 0.8 AS cleared FROM f")
def _(spark, d):
    ratio = S.ratio(F.col("supported"), F.col("supported") + F.col("contradicted") + F.col("shifted"))
    return facts(spark, d).select("event_id", ratio.alias("ratio"), (ratio >= 0.8).alias("cleared"))


_STRATEGIES = {"contradicted": "contradicted > 0", "shifted": "shifted > 0", "either": "contradicted > 0 OR shifted > 0", "both": "contradicted > 0 AND shifted > 0", "unsupported": "supported = 0"}


@query("strategy_compare", f"WITH {_FACT}, e AS (SELECT f.*, value > 20 AS bad FROM f JOIN events USING (event_id)) " + " UNION ALL ".join(f"SELECT '{n}' AS strategy, count(*) FILTER (({c}) AND bad) AS tp, count(*) FILTER (({c}) AND NOT bad) AS fp, count(*) FILTER (NOT ({c}) AND bad) AS fn FROM e" for n, c in _STRATEGIES.items()))
def _(spark, d):
    rows = facts(spark, d).join(governance_events(spark, d).select("event_id", (F.col("value") > 20).alias("bad")), "event_id")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), F.expr(c).alias("hit")) for n, c in _STRATEGIES.items()]))
    x = rows.select("bad", each.alias("s")).select("bad", "s.*")
    return x.groupBy("strategy").agg(F.count_if(F.col("hit") & F.col("bad")).alias("tp"), F.count_if(F.col("hit") & ~F.col("bad")).alias("fp"), F.count_if(~F.col("hit") & F.col("bad")).alias("fn"))


@query("score_sanitize", "SELECT event_id, least(greatest(coalesce(k // 10, 3), 1), 5)::INT AS tone, 3 AS clarity, least(greatest(value / 100, 0.0), 1.0) AS confidence FROM (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)")
def _(spark, d):
    scores, sure = providers.sanitized(F.create_map(F.lit("tone"), F.floor(F.col("k") / 10).cast("int")), F.col("value") / 100, ("tone", "clarity"))
    return governance_events(spark, d).select("event_id", F.element_at(scores, F.lit("tone")).alias("tone"), F.element_at(scores, F.lit("clarity")).alias("clarity"), sure.alias("confidence"))


@query("flag_reasons", "SELECT CASE WHEN event_type = 'error' THEN 'entity_no_actions' WHEN event_type = 'click' THEN 'negation_contradiction' ELSE 'verb_not_found' END AS reason, count(*) AS n FROM events WHERE event_type <> 'signup' GROUP BY 1")
def _(spark, d):
    e = F.col("event_type")
    text = F.when(e == "error", "entity has NO actions").when(e == "click", "relation is NEGATED").when(e == "signup", "fine").otherwise("verb not found")
    reason = F.when(text.contains("NO actions"), "entity_no_actions").when(text.contains("NOT in graph"), "entity_not_in_graph").when(text.contains("NEGATED"), "negation_contradiction").when(text.contains("not found"), "verb_not_found")
    return table(spark, d, "events").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n")).where("reason is not null")


@query("qa_match", "SELECT conv_id, turn, contains(lower(text), lower(split_part(text, ' ', 2))) OR false AS answered FROM conversations")
def _(spark, d):
    answer, claim = F.lower(F.split_part("text", F.lit(" "), F.lit(2))), F.lower("text")
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    share = F.coalesce(F.try_divide(F.size(F.array_intersect(words(answer), words(claim))), F.size(F.array_distinct(words(answer)))), F.lit(0.0))
    return table(spark, d, "conversations").select("conv_id", "turn", (claim.contains(answer) | (share >= 0.5)).alias("answered"))


_TRIPLES = "t AS (SELECT o_orderkey AS k, 'order ' || o_orderstatus AS s, o_orderpriority AS r, 'clerk ' || (o_orderkey % 7) AS o FROM orders)"


@query("graph_edges", f"WITH {_TRIPLES} SELECT k, 'G3' AS graph, s AS src, o AS dst, r AS relation, CASE WHEN k % 3 = 0 THEN 'NOT' ELSE '+' END AS polarity FROM t WHERE k % 5 <> 0")
def _(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k.alias("k"), "o_orderstatus", "o_orderpriority")
    target = F.when(F.col("k") % 5 != 0, F.concat(F.lit("clerk "), (F.col("k") % 7).cast("string")))
    return graphs.edges(rows, "k", "G3", F.concat(F.lit("order "), "o_orderstatus"), F.col("o_orderpriority"), target, F.col("k") % 3 == 0)


@query("graph_lookup", "SELECT p_brand, verdict, count(*) AS n FROM (SELECT p_brand, CASE WHEN p_partkey % 3 = 0 THEN 'flagged' WHEN p_partkey % 2 = 0 THEN 'grounded' ELSE 'flagged' END AS verdict FROM part) GROUP BY 1, 2")
def _(spark, d):
    """Every part is an entity with one edge, NOT for every third; every second mention names its target."""
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    e = p.select(F.col("p_partkey").alias("key"), F.lit("graph").alias("g"), F.lit("part").alias("src"), F.col("p_brand").alias("dst"), F.lit("bears").alias("relation"), F.when(F.col("p_partkey") % 3 == 0, "NOT").otherwise("+").alias("polarity"))
    named = F.when((F.col("p_partkey") % 2 == 0) | (F.col("p_partkey") % 3 == 0), F.col("p_brand")).otherwise("another")
    mentions = p.select(F.col("p_partkey").alias("key"), F.lit("Part").alias("entity"), F.lit("bears").alias("action"), named.alias("target"))
    found = graphs.two_hops(mentions, e, "key").join(p.withColumnRenamed("p_partkey", "key"), "key")
    return found.groupBy("p_brand", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query("entity_resolve", "SELECT n_nationkey AS k, n_name AS mention, n_name AS node FROM nation")
def _(spark, d):
    n = table(spark, d, "nation").select("n_regionkey", "n_nationkey", "n_name")
    nodes = n.select(F.col("n_regionkey").alias("key"), F.col("n_name").alias("node"), F.col("n_nationkey").alias("ord"), F.array(F.concat(F.lit("the land of "), F.lower("n_name"))).alias("aliases"))
    found = grounding.resolve_entity(n.select(F.col("n_regionkey").alias("key"), F.col("n_name").alias("mention")), nodes, "key")
    return found.join(n.withColumnRenamed("n_name", "mention"), "mention").select(F.col("n_nationkey").alias("k"), "mention", "node")


@query("triplet_match")
def _(spark, d):
    """Order lines as triplets against their order's own; the tests hold it against a double loop."""
    lines = table(spark, d, "lineitem")
    t = lambda obj: lines.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ord"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("subject"), F.lower("l_linestatus").alias("predicate"), obj.alias("object"))
    return grounding.triplet_matches(t(F.lower("l_returnflag")), t(F.concat_ws(" ", F.lower("l_returnflag"), F.lower("l_linestatus"))), "k")


@query("grounding_ratio")
def _(spark, d):
    """Every answer's sentences against every sentence of its question, as hashed embeddings; no oracle, as the hash is Spark's."""
    ratio, least = grounding.grounding_ratio(F.col("answer"), F.col("question"), lambda s: providers.hashed_embedding(s, 64))
    rows = pairs(spark, d).select("conv_id", "turn", ratio.alias("ratio"), least.alias("least_similarity"))
    return rows.select("*", grounding.gate(F.col("ratio"), F.col("least_similarity")).alias("decision"))


@query("fabrication", "SELECT vec_id, best < 0.3 AS suspect FROM (SELECT a.vec_id, max(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS best FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id GROUP BY 1)")
def _(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return ranking.alone(e, 0.3).select(F.col("id").alias("vec_id"), F.col("alone").alias("suspect"))


@query("envelope_verify")
def _(spark, d):
    """Rows signed and verified, every third tampered with in between."""
    body = F.to_json(F.struct("event_id", "event_type", "user_id"))
    tampered = F.when(F.col("event_id") % 3 == 0, F.regexp_replace("body", "user_id", "user-id")).otherwise(F.col("body"))
    rows = table(spark, d, "events").select("event_id", body.alias("body")).withColumn("signature", providers.signed(F.col("body"), "key"))
    return rows.select("event_id", (providers.signed(tampered, "key") == F.col("signature")).alias("valid"))


@query("events_tumbling", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS total FROM events GROUP BY 1, 2")
def _(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.tumbling(e, "6 hours", ["event_type"], F.round(F.col("value") * 100).cast("long"))


@query("events_sliding", "SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR, time_bucket(INTERVAL 1 HOUR, ts)]) AS start FROM events) GROUP BY 1, 2")
def _(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.sliding(e, "2 hours", "1 hour", ["event_type"])


@query("events_session", "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 3 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s")
def _(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.sessions(e, "3 hours", ["user_id"])


@query("retention_rank", "SELECT user_id, event_type, n, rank() OVER (PARTITION BY event_type ORDER BY n DESC) AS rank FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)")
def _(spark, d):
    by = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("rank", F.rank().over(Window.partitionBy("event_type").orderBy(F.desc("n"))).cast("long"))


