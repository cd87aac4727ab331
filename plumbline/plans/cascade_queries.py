"""Lexical clearing by all its kinds, the cascade, sweeps, generated cases, judges, chains, heartbeats."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog import query
from plumbline.functions import stats as S
from plumbline.functions import text as T
from plumbline.operators import cascade, engines, generators, grounding, metrics, properties, providers, ranking, rules
from plumbline.operators import suite as properties_suite
from plumbline.plans.base import PAIRS, pairs, table
from plumbline.plans.text_queries import _SENTS, _SQ
from plumbline.streaming import bus

# An answer's own sentences, edited by their place, against the answer: as they stand, with other white
# space, with their words turned round, without every second word, and with a word more.
_EDIT = """CASE pos % 5 WHEN 0 THEN s WHEN 1 THEN replace(s, ' ', '  ') WHEN 2 THEN array_to_string(list_reverse(string_split(s, ' ')), ' ')
  WHEN 3 THEN array_to_string(list_filter(string_split(s, ' '), lambda w, i: i % 2 = 1), ' ') ELSE s || ' indeed' END"""
_WORDS = lambda t: f"list_distinct(regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}_]+'))"
_EDITED = f"""{PAIRS}, e0 AS (SELECT conv_id, turn, answer AS source, {_SENTS.format(t='answer')} AS ss FROM pairs),
  e1 AS (SELECT conv_id, turn, source, ss, unnest(ss) AS s, unnest(range(len(ss)))::INT AS pos FROM e0), e2 AS (SELECT conv_id, turn, pos, source, ss, {_EDIT} AS sentence FROM e1),
  e3 AS (SELECT *, {_WORDS('sentence')} AS o, list_transform(ss, lambda x: {_WORDS('x')}) AS sw FROM e2),
  l1 AS (SELECT conv_id, turn, pos, sentence, o, sw, CASE WHEN contains({_SQ('source')}, {_SQ('sentence')}) THEN 'exact_substring'
    WHEN len(o) > 0 AND len(list_filter(sw, lambda x: len(list_intersect(o, x))::DOUBLE / len(list_distinct(list_concat(o, x))) > 0.8)) > 0 THEN 'token_overlap' ELSE 'no_match' END AS match FROM e3)"""


def edited(spark, d):
    p = pairs(spark, d).select("conv_id", "turn", F.col("answer").alias("source"), T.sentences(F.col("answer")).alias("source_sentences"))
    p = p.select("*", F.posexplode("source_sentences").alias("pos", "s"))
    words = F.split("s", " ")
    made = (
        F.when(F.col("pos") % 5 == 0, F.col("s")).when(F.col("pos") % 5 == 1, F.replace("s", F.lit(" "), F.lit("  ")))
        .when(F.col("pos") % 5 == 2, F.array_join(F.reverse(words), " ")).when(F.col("pos") % 5 == 3, F.array_join(F.filter(words, lambda w, i: i % 2 == 0), " "))
        .otherwise(F.concat("s", F.lit(" indeed")))
    )
    return p.select("conv_id", "turn", "pos", "source", "source_sentences", made.alias("sentence"))


@query("l1_lexical", f"WITH {_EDITED} SELECT conv_id, turn, pos, match FROM l1")
def _(spark, d):
    return edited(spark, d).select("conv_id", "turn", "pos", grounding.match_type(F.col("sentence"), F.col("source"), F.col("source_sentences")).alias("match"))


@query("l1_full")
def _(spark, d):
    """All four kinds; the ratio of matching blocks is Python, and the tests hold it against brute force."""
    return grounding.cleared_sentences(edited(spark, d)).select("conv_id", "turn", "pos", "match")


@query(
    "fact_counting",
    """WITH a AS (SELECT event_id, event_id % 10 = 0 AS error, event_id % 10 = 1 AS bare, event_id % 7 AS s, event_id % 2 AS n FROM events),
  b AS (SELECT *, CASE WHEN error OR bare THEN 0 ELSE s END AS supported, CASE WHEN error OR bare THEN 0 WHEN s + n = 0 THEN 9 ELSE s + n END AS total FROM a),
  c AS (SELECT *, CASE WHEN total > 0 THEN round(supported::DOUBLE / total, 3) ELSE 0.0 END AS ratio FROM b)
  SELECT event_id, supported::INT AS supported, total::INT AS total, ratio, NOT error AND ratio >= 0.8 AS auto_clear, error,
    CASE WHEN error THEN NULL WHEN bare THEN 'GROUNDED' WHEN event_id % 3 = 0 THEN 'HALLUCINATED' WHEN ratio >= 0.8 THEN 'GROUNDED' ELSE 'HALLUCINATED' END AS verdict FROM c""",
)
def _(spark, d):
    e = F.col("event_id")
    counted = F.concat(F.lit('```json\n{"supported": '), e % 7, F.lit(', "not_found": '), e % 2, F.lit(', "total": 9, "verdict": "'), F.when(e % 3 == 0, "hallucinated").otherwise("?"), F.lit('",}\n```'))
    reply = F.when(e % 10 == 0, "no object here").when(e % 10 == 1, '{"verdict": "grounded"}').otherwise(counted)
    found = cascade.fact_counts(reply)
    return table(spark, d, "events").select("event_id", *[found[c].alias(c) for c in ("supported", "total", "ratio", "auto_clear", "verdict", "error")])


_CASCADE = f"""{_EDITED}, k AS (SELECT conv_id, turn, pos, match, len(string_split(sentence, ' ')) % 7 AS n,
    CASE WHEN len(o) = 0 THEN 0.0 ELSE coalesce(list_max(list_transform(sw, lambda x: len(list_intersect(o, x))::DOUBLE / len(o))), 0.0) END AS best FROM l1),
  r AS (SELECT conv_id, turn, pos, CASE WHEN match <> 'no_match' THEN 'L1' WHEN best > 0.7 THEN 'L2' WHEN n >= 4 THEN 'L3' WHEN pos % 11 = 0 OR pos % 2 = 0 THEN 'L4' ELSE 'L4_flagged' END AS resolved_by FROM k)"""


def resolved(spark, d):
    """Sentences through four layers: words, entailment by containment, counted facts, and a verdict in words."""
    rows = edited(spark, d)
    match = grounding.match_type(F.col("sentence"), F.col("source"), F.col("source_sentences"))
    rows = rows.withColumn("_n", F.size(F.split("sentence", " ")) % 7)

    def facts(left):
        found = cascade.fact_counts(F.concat(F.lit('{"supported": '), F.col("_n"), F.lit(', "contradicted": 1}')))
        return left.withColumn("verdict", F.when(found["auto_clear"], "clear").when(found["ratio"] < 0.5, "flagged"))

    def words(left):
        said = F.when(F.col("pos") % 2 == 0, "It is supported.").otherwise("It is unsupported.")
        return left.withColumn("verdict", F.when(cascade.model_verdict(said, F.col("pos") % 11 == 0), "clear").otherwise("flagged"))

    entails = cascade.entailment(cascade.containment_score, "sentence", "source_sentences", cascade.containment_score)
    return cascade.driver(rows, match != "no_match", [("L2", entails), ("L3", facts), ("L4", words)])


@query("cascade_full", f"WITH {_CASCADE} SELECT conv_id, turn, pos, resolved_by FROM r")
def _(spark, d):
    return resolved(spark, d).select("conv_id", "turn", "pos", "resolved_by")


@query(
    "cascade_risk",
    f"WITH {_CASCADE}, u AS (SELECT conv_id, turn, count(*) AS sentences, count(*) FILTER (resolved_by LIKE '%flagged') AS unsupported FROM r GROUP BY 1, 2) SELECT *, (sentences - unsupported)::DOUBLE / sentences::DOUBLE AS ratio, CASE WHEN unsupported = 0 THEN 0.0 ELSE 0.5 + 0.5 * (unsupported::DOUBLE / sentences::DOUBLE) END AS risk FROM u",
)
def _(spark, d):
    return cascade.risk(resolved(spark, d), ["conv_id", "turn"])


# Similarities of sentences by their letters, which SQL can count.
_PROFILE = "list_transform(['a','b','c','d','e','f','g','h','i','j','k','l','m','n','o','p','q','r','s','t','u','v','w','x','y','z'], lambda ch: (length(lower({t})) - length(replace(lower({t}), ch, '')))::DOUBLE)"
_COS = "CASE WHEN list_dot_product(v, v) > 0 AND list_dot_product(w, w) > 0 THEN list_dot_product(v, w) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(w, w))) ELSE 0.0 END"
_SIMS = f"""{PAIRS}, g0 AS (SELECT conv_id, turn, question, answer, list_transform({_SENTS.format(t='answer')}, lambda x: {_PROFILE.format(t='x')}) AS r, list_transform({_SENTS.format(t='question')}, lambda x: {_PROFILE.format(t='x')}) AS c FROM pairs),
  sims AS (SELECT conv_id, turn, question, answer, len(r) AS nr, len(c) AS nc, list_transform(r, lambda v: list_max(list_transform(c, lambda w: {_COS}))) AS s FROM g0)"""
_OVERLAP = "coalesce(len(list_intersect({a}, {q}))::DOUBLE / nullif(len({a}), 0)::DOUBLE, 1.0)"


@query(
    "grounding_gate_full",
    f"""WITH {_SIMS}, o AS (SELECT *, list_distinct(list_filter(list_transform(string_split_regex(lower(answer), '\\s+'), lambda t: trim(t, '.,!?;:"''()[]{{}}')), lambda t: length(t) > 2)) AS ta, list_distinct(list_filter(list_transform(string_split_regex(lower(question), '\\s+'), lambda t: trim(t, '.,!?;:"''()[]{{}}')), lambda t: length(t) > 2)) AS tq FROM sims),
  f AS (SELECT conv_id, turn, CASE WHEN nr = 0 THEN 1.0 WHEN nc = 0 THEN {_OVERLAP.format(a='ta', q='tq')} ELSE len(list_filter(s, lambda v: v >= 0.9))::DOUBLE / nr::DOUBLE END AS ratio,
    CASE WHEN nr = 0 THEN 1.0 WHEN nc = 0 THEN {_OVERLAP.format(a='ta', q='tq')} ELSE list_min(s) END AS least FROM o)
  SELECT conv_id, turn, round(ratio, 9) AS ratio, round(least, 9) AS least, CASE WHEN ratio < 0.8 OR least < 0.85 THEN CASE WHEN (ratio < 0.8 AND ratio >= 0.8::DOUBLE - 0.1::DOUBLE) OR (least < 0.85 AND least >= 0.85::DOUBLE - 0.05::DOUBLE) THEN 'ambiguous' ELSE 'fail' END ELSE 'pass' END AS decision FROM f""",
)
def _(spark, d):
    p = pairs(spark, d)
    ratio, least = grounding.grounding_ratio(F.col("answer"), F.col("question"), providers.letter_profile, threshold=0.9)
    p = p.select("conv_id", "turn", ratio.alias("ratio"), least.alias("least"))
    return p.select("conv_id", "turn", F.round("ratio", 9).alias("ratio"), F.round("least", 9).alias("least"), grounding.gate(F.col("ratio"), F.col("least"), 0.8, 0.85).alias("decision"))


def _cases(spark, d):
    p = pairs(spark, d).select((F.pmod(F.col("conv_id") + F.col("turn"), F.lit(3)) == 0).alias("bad"), cascade.similarities(F.col("answer"), F.col("question"), providers.letter_profile).alias("s"))
    # Similarities of letters are high, so they are spread to where the grids look.
    return p.where("s is not null and size(s) > 0").select("bad", F.transform("s", lambda v: F.round((v - 0.7) * 2.5, 6)).alias("s"))


_LIST = lambda xs: "[" + ", ".join(f"{x!r}::DOUBLE" for x in xs) + "]"
_SPREAD = "cs AS (SELECT (conv_id + turn) % 3 = 0 AS bad, list_transform(s, lambda v: round((v - 0.7::DOUBLE) * 2.5::DOUBLE, 6)) AS s FROM sims WHERE nr > 0 AND nc > 0)"
_CELLS = "count(*) FILTER (hit AND bad) AS tp, count(*) FILTER (hit AND NOT bad) AS fp, count(*) FILTER (NOT hit AND bad) AS fn, count(*) FILTER (NOT hit AND NOT bad) AS tn"
_SCORED = """p AS (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0)::DOUBLE, 0.0) AS pr, coalesce(tp::DOUBLE / nullif(tp + fn, 0)::DOUBLE, 0.0) AS re FROM k),
  q AS (SELECT * EXCLUDE (pr, re), round(pr, 4) AS precision, round(re, 4) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0.0), 4) AS f1, round((tp + fp)::DOUBLE / (tp + fp + fn + tn)::DOUBLE, 4) AS fire_rate FROM p)"""
_SHARE = "len(list_filter(s, lambda v: v >= similarity))::DOUBLE / len(s)::DOUBLE < ratio"
_T1 = f"""{_SIMS}, {_SPREAD}, gr AS (SELECT a AS similarity, b AS ratio FROM (SELECT unnest({_LIST(cascade.SIMILARITIES)}) AS a), (SELECT unnest({_LIST(cascade.RATIOS)}) AS b)),
  h AS (SELECT similarity, ratio, bad, {_SHARE} AS hit FROM cs, gr), k AS (SELECT 'grid' AS strategy, similarity, ratio, NULL::DOUBLE AS least, {_CELLS} FROM h GROUP BY similarity, ratio), {_SCORED}"""
_T2 = f"""{_SIMS}, {_SPREAD}, ga AS (SELECT unnest({_LIST(cascade.THREE["similarities"])}) AS similarity), gb AS (SELECT unnest({_LIST(cascade.THREE["ratios"])}) AS ratio), gc AS (SELECT unnest({_LIST(cascade.THREE["least"])}) AS least),
  h AS (SELECT 'ratio_only' AS strategy, similarity, ratio, NULL::DOUBLE AS least, bad, {_SHARE} AS hit FROM cs, ga, gb
    UNION ALL SELECT 'min_sim_only', NULL, NULL, least, bad, list_min(s) < least FROM cs, gc
    UNION ALL SELECT 'dual', similarity, ratio, least, bad, {_SHARE} OR list_min(s) < least FROM cs, ga, gb, gc),
  k AS (SELECT strategy, similarity, ratio, least, {_CELLS} FROM h GROUP BY strategy, similarity, ratio, least), {_SCORED}"""
_BEST = "SELECT strategy, similarity, ratio, least, f1, fire_rate FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY f1 DESC, coalesce(similarity, -1), coalesce(ratio, -1), coalesce(least, -1)) AS n FROM q) WHERE n = 1"


@query("sweep_grid", f"WITH {_T1} SELECT * FROM q")
def _(spark, d):
    return cascade.swept(_cases(spark, d), [("grid", a, b, None) for a in cascade.SIMILARITIES for b in cascade.RATIOS], "s", "bad")


@query("sweep_strategies", f"WITH {_T2} SELECT * FROM q")
def _(spark, d):
    return cascade.swept(_cases(spark, d), cascade.sweep_points(), "s", "bad")


@query("sweep_best", f"WITH {_T2} {_BEST}")
def _(spark, d):
    return cascade.best_points(cascade.swept(_cases(spark, d), cascade.sweep_points(), "s", "bad"))


@query(
    "fabrication_sentences",
    f"WITH {_SIMS} SELECT conv_id, turn, nr::INT AS checked, CASE WHEN nc = 0 THEN nr ELSE len(list_filter(s, lambda v: v < 0.85)) END::INT AS suspects FROM sims",
)
def _(spark, d):
    # Vectors of letters are made once for each sentence, so the similarity is that of two vectors.
    best = cascade.similarities(F.col("answer"), F.col("question"), providers.letter_profile)
    p = pairs(spark, d).select("conv_id", "turn", F.size(T.sentences(F.col("answer"))).alias("checked"), best.alias("s"))
    return p.select("conv_id", "turn", "checked", F.when(F.col("s").isNull(), F.col("checked")).otherwise(F.size(F.filter("s", lambda v: v < 0.85))).alias("suspects"))


@query("attribution")
def _(spark, d):
    """Citations put into answers, held against their questions; the tests hold windows and counts against Python."""
    p = pairs(spark, d)
    cited = F.concat(F.substring("answer", 1, 150), F.lit(" According to the report, "), F.substring("question", 1, 120), F.lit(" [3] "), F.substring("answer", 151, 400))
    found = cascade.attribution(cited, F.col("question"), properties.CITATIONS, cascade.containment_score)
    return p.select("conv_id", "turn", *[v.alias(k) for k, v in found.items()])


@query("property_suite_all")
def _(spark, d):
    """All 28 properties of answers; those that need a model or a whole run say pass."""
    p = pairs(spark, d)
    verdicts = properties_suite.all_properties(F.col("answer"), F.col("question"), F.col("question"), cascade.containment_score)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("property"), v.alias("decision")) for k, v in verdicts.items()]))
    return p.select("conv_id", "turn", each.alias("x")).select("conv_id", "turn", "x.*")


@query(
    "property_suite_safe",
    """WITH PAIRS_SQL SELECT conv_id, turn, unnest(['2.1', '5.3', '6.2']) AS property, 'pass' AS decision FROM pairs UNION ALL
  SELECT conv_id, turn, '4.2', CASE WHEN trim(answer) = '' THEN 'fail' ELSE 'pass' END FROM pairs""".replace("PAIRS_SQL", PAIRS),
)
def _(spark, d):
    p = pairs(spark, d)
    verdicts = properties_suite.all_properties(F.col("answer"), F.col("question"), F.col("question"), cascade.containment_score)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("property"), verdicts[k].alias("decision")) for k in ("2.1", "4.2", "5.3", "6.2")]))
    return p.select("conv_id", "turn", each.alias("x")).select("conv_id", "turn", "x.*")


# Requests
_CONV = "cv AS (SELECT conv_id, list(role ORDER BY turn) AS roles, list(text ORDER BY turn) AS texts FROM conversations GROUP BY conv_id)"


@query(
    "requests",
    f"WITH {_CONV} SELECT conv_id, coalesce(texts[len(texts)], '') AS last, CASE WHEN conv_id % 3 = 0 THEN texts[1] || chr(10) || chr(10) || 'more' ELSE coalesce(nullif(coalesce(list_last(list_filter(texts, lambda t, i: roles[i] = 'user')), texts[1]), ''), 'the answer') END AS source FROM cv",
)
def _(spark, d):
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    c = table(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("conversation"))
    contexts = F.when(F.col("conv_id") % 3 == 0, F.array(F.get("conversation", 0)["content"], F.lit(""), F.lit("more"))).otherwise(F.array().cast("array<string>"))
    return c.select("conv_id", engines.last_message(F.col("conversation")).alias("last"), engines.request_source(contexts, F.col("conversation"), F.lit("the answer")).alias("source"))


@query(
    "confidence_monotone",
    """WITH b AS (SELECT CASE WHEN n_chars % 100 < 30 THEN 0 WHEN n_chars % 100 < 70 THEN 1 ELSE 2 END AS bin, round((count(*) FILTER (n_chars % 3 = 0))::DOUBLE / count(*)::DOUBLE, 3) AS accuracy FROM documents GROUP BY 1),
  l AS (SELECT coalesce(accuracy >= lag(accuracy) OVER (ORDER BY bin), true) AS ok FROM b) SELECT count(*) AS bins, bool_and(ok) AS monotonic, CASE WHEN bool_and(ok) THEN 'pass' ELSE 'fail' END AS decision FROM l""",
)
def _(spark, d):
    n = F.col("n_chars")
    bin_ = F.when(n % 100 < 30, 0).when(n % 100 < 70, 1).otherwise(2)
    bins = table(spark, d, "documents").groupBy(bin_.alias("bin")).agg(F.round(S.ratio(F.count_if(n % 3 == 0), F.count(F.lit(1))), 3).alias("accuracy"))
    return metrics.monotone(bins, "bin", "accuracy")


@query("first_events", "SELECT user_id, array_to_string(list(event_id ORDER BY n), ',') AS events FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n <= 10 GROUP BY user_id")
def _(spark, d):
    rows = table(spark, d, "events").withColumn("event", F.col("event_id").cast("string"))
    out = ranking.first_of(rows, ["user_id"], [F.col("ts"), F.col("event_id")], "event", ranking.SHOWN["events"])
    return out.select("user_id", F.array_join("items", ",").alias("events"))


@query(
    "math_expressions",
    """SELECT l_orderkey, l_linenumber, abs((CASE WHEN l_linenumber % 2 = 0 THEN q + n * 3.0 - q ELSE q - p % 7 * n END + CASE WHEN l_orderkey % 4 = 0 THEN 1 ELSE 0 END) -
  (CASE WHEN l_linenumber % 2 = 0 THEN q + n * 3.0 - q ELSE q - p % 7 * n END)) > 1e-9 AS wrong FROM (SELECT *, l_quantity::BIGINT AS q, l_linenumber::BIGINT AS n, l_partkey AS p FROM lineitem)""",
)
def _(spark, d):
    q, n, p = F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long"), F.col("l_partkey")
    even = F.col("l_linenumber") % 2 == 0
    asked = F.when(even, F.concat_ws(" ", q.cast("string"), F.lit("+"), n.cast("string"), F.lit("* 3.0 -"), q.cast("string"))).otherwise(F.concat_ws(" ", q.cast("string"), F.lit("-"), p.cast("string"), F.lit("% 7 *"), n.cast("string")))
    value = F.when(even, n * 3).otherwise(q - p % 7 * n) + F.when(F.col("l_orderkey") % 4 == 0, 1).otherwise(0)
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("What is "), asked, F.lit("?")).alias("question"), F.concat(F.lit("The answer is "), value.cast("string"), F.lit(".")).alias("answer"))
    return rows.select("l_orderkey", "l_linenumber", rules.expression_wrong("question", "answer").alias("wrong"))


_PICK = lambda key, n, seed: f"(('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT % {n})"
_QL = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


@query(
    "diagnostic_cases",
    f"""WITH c AS (SELECT item_id AS key, substr(text, 1, 80) AS q, substr(text, 81, 200) AS r FROM benchmark) SELECT key, 'position_bias' AS protocol, q AS query, r AS response FROM c
  UNION ALL SELECT key, 'consistency', {_QL(generators.PARAPHRASES)}[{_PICK('key', 5, 'diagnostic:paraphrase')} + 1] || lower(q), r FROM c
  UNION ALL SELECT key, 'adversarial', {_QL(generators.ADVERSARIAL)}[{_PICK('key', 5, 'diagnostic:attack')} + 1] || q, r FROM c
  UNION ALL SELECT key, 'edge_empty', q, '' FROM c UNION ALL SELECT key, 'edge_blank', q, '   ' FROM c UNION ALL SELECT key, 'edge_short', q, substr(r, 1, 1) FROM c
  UNION ALL SELECT key, 'edge_repeated', q, r || ' ' || r || ' ' || r FROM c UNION ALL SELECT key, 'edge_echo', q, q FROM c""",
)
def _(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", F.substring("text", 1, 80).alias("q"), F.substring("text", 81, 200).alias("r"))
    # Capitals of some letters differ between engines, so those answers stay out of the comparison.
    return generators.diagnostic_cases(rows, F.col("item_id"), "q", "r").where("protocol <> 'edge_upper'")


_MATH = f"""m AS (SELECT id, {_PICK('id', 101, 'math:a')} - 50 AS a, {_PICK('id', 101, 'math:b')} - 50 AS b, ['+', '-', '*'][{_PICK('id', 3, 'math:op')} + 1] AS op, {_PICK('id', 2, 'math:good')} = 0 AS good,
    {_PICK('id', 10, 'math:delta')} AS dl, {_PICK('id', 4, 'math:ask')} AS ask, {_PICK('id', 2, 'math:say')} AS say FROM range(2000) t(id)),
  v AS (SELECT *, a || ' ' || op || ' ' || b AS e, CASE op WHEN '+' THEN a + b WHEN '-' THEN a - b ELSE a * b END + CASE WHEN good THEN 0 WHEN dl < 5 THEN dl + 1 ELSE 4 - dl END AS x FROM m)"""


@query(
    "math_cases",
    f"WITH {_MATH} SELECT printf('math_%06d', id) AS case_id, CASE ask WHEN 0 THEN 'What is ' || e || '?' WHEN 1 THEN 'Compute ' || e || '.' WHEN 2 THEN 'Solve: ' || e ELSE 'Can you tell me ' || e || '?' END AS question, CASE say WHEN 0 THEN x::VARCHAR ELSE 'The answer is ' || x || '.' END AS answer, CASE WHEN good THEN 'pass' ELSE 'fail' END AS expected FROM v",
)
def _(spark, d):
    return generators.math_cases(spark, 2000)


@query("math_cases_judged", f"WITH {_MATH} SELECT count(*) AS n, count(*) FILTER (NOT good) AS wrong, count(*) AS agree FROM v")
def _(spark, d):
    rows = generators.math_cases(spark, 2000).withColumn("wrong", rules.expression_wrong("question", "answer"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("wrong").alias("wrong"), F.count_if(F.col("wrong") == (F.col("expected") == "fail")).alias("agree"))


# Judges and chains
@query(
    "trust_gate",
    """WITH c AS (SELECT s_nationkey AS k, max_by(s_acctbal > 0, s_suppkey) AS passed FROM supplier GROUP BY 1), j AS (SELECT n_name AS judge_id, n_nationkey % 7 = 0 AS det, ['registered', 'calibrated', 'blocked', 'calibrating', 'retired'][n_nationkey % 5 + 1] AS st, coalesce(passed, false) AS passed FROM nation LEFT JOIN c ON k = n_nationkey)
  SELECT judge_id, det OR (st = 'calibrated' AND passed) AS allowed, CASE WHEN det THEN 'deterministic' WHEN st = 'blocked' THEN 'blocked' WHEN st = 'calibrated' AND passed THEN 'calibrated' WHEN st = 'calibrated' THEN 'unverified' WHEN st IN ('registered', 'calibrating') THEN 'uncalibrated' ELSE 'unknown status' END AS reason FROM j""",
)
def _(spark, d):
    status = F.get(F.array(*map(F.lit, ("registered", "calibrated", "blocked", "calibrating", "retired"))), F.pmod("n_nationkey", F.lit(5)).cast("int"))
    nations = table(spark, d, "nation")
    judges = nations.select(F.col("n_name").alias("judge_id"), F.when(F.col("n_nationkey") % 7 == 0, "deterministic").otherwise("llm").alias("engine"), status.alias("status"))
    results = table(spark, d, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("judge_id"), F.col("s_suppkey").alias("at"), (F.col("s_acctbal") > 0).alias("passed"))
    return engines.trusted(judges, results, enforce=True)


_CHAIN = f"""{PAIRS}, a AS (SELECT conv_id, turn, length(answer) AS n FROM pairs),
  b AS (SELECT *, CASE WHEN conv_id % 5 = 0 THEN 'failure' WHEN n % 9 = 0 THEN 'denied' ELSE 'success' END AS s1 FROM a),
  c AS (SELECT *, CASE WHEN s1 <> 'success' THEN 'skipped' WHEN n % 4 = 3 THEN 'failure' ELSE 'success' END AS s2, CASE WHEN s1 <> 'success' THEN 'skipped' ELSE 'success' END AS s7 FROM b)"""


@query("evaluation_chain", f"WITH {_CHAIN} SELECT conv_id, turn, s1 || ',' || s2 || ',' || s7 || ',success' AS statuses, s1 = 'success' AND s2 = 'success' AS complete, (s1 = 'success')::INT + (s2 = 'success')::INT + (s7 = 'success')::INT + 1 AS outputs FROM c")
def _(spark, d):
    n = F.length("answer")
    step = lambda error, ms: lambda rows: rows.withColumns({"output": F.lit(""), "error": F.when(error, "broken"), "duration_ms": ms})
    runs = {
        "CAP-1": step(F.col("conv_id") % 5 == 0, F.when(n % 9 == 0, 5001.0).otherwise(5000.0)),
        "CAP-2": step(n % 4 == 3, F.lit(1.0)),
        "CAP-7": step(F.lit(False), F.lit(29_999.0)),
        "CAP-5": step(F.lit(False), F.lit(None).cast("double")),
    }
    chain = engines.Chain([engines.Capability(name, runs[name], limit, after) for name, limit, after in engines.CHAIN], [engines.timeout_guard])
    out = chain.run(pairs(spark, d))
    statuses = F.array_join(F.transform("integrity", lambda r: r["status"]), ",")
    return out.select("conv_id", "turn", statuses.alias("statuses"), "complete", F.size("outputs").alias("outputs"))


@query(
    "sequential_judge",
    f"WITH {PAIRS} SELECT conv_id, turn, CASE WHEN length(answer) % 3 = 0 AND length(answer) % 2 = 1 THEN 'fail' ELSE 'pass' END AS decision, CASE WHEN length(answer) % 3 = 0 AND length(answer) % 2 = 1 THEN 'second' ELSE 'first' END AS engine FROM pairs",
)
def _(spark, d):
    n, none = F.length("answer"), F.array().cast("array<string>")
    first = lambda rows: rows.withColumns({"decision": F.lit("pass"), "confidence": F.when(n % 3 == 0, 0.5).otherwise(0.9), "flags": none, "engine": F.lit("first")})
    second = lambda rows: rows.withColumns({"decision": F.lit("fail"), "confidence": F.lit(0.8), "flags": none, "engine": F.lit("second"), "error": F.when(n % 2 == 0, "down")})
    judge = engines.judge_engine("sequential", gate1=first, gate2=second)
    return judge(pairs(spark, d)).select("conv_id", "turn", "decision", "engine")


@query(
    "heartbeats",
    "WITH b AS (SELECT user_id, max(ts) AS last, count(*) AS beats FROM events GROUP BY 1), x AS (SELECT *, epoch(TIMESTAMP '2024-02-01 00:00:00') - floor(epoch(last)) AS age FROM b) SELECT user_id, beats, CASE WHEN age > 259200 THEN 'lost' WHEN age > 86400 THEN 'late' ELSE 'alive' END AS status FROM x",
)
def _(spark, d):
    beats = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return bus.silent(beats, "user_id", "ts", "2024-02-01 00:00:00", 86400).select("user_id", "beats", "status")
