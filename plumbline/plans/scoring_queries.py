"""Scores, rules and the metrics of a judge against people."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog import query
from plumbline.functions import text as T
from plumbline.operators import metrics, rules, scoring
from plumbline.plans.base import DOCUMENT_CASES, HUMAN, PAIRS, apart, document_cases, human_labels, pairs, q, rates, ratio, table

_LIST = lambda items: "[" + ", ".join(map(q, items)) + "]"
_LIKE = lambda t, phrases: "(" + " OR ".join(f"contains({t}, {q(p)})" for p in phrases) + ")"
_COUNT = lambda t, phrases: "(" + " + ".join(f"contains({t}, {q(p)})::INT" for p in phrases) + ")"


def _content(t: str) -> str:
    synonyms = "CASE t " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in scoring.SYNONYMS.items()) + " ELSE t END"
    return f"list_distinct(list_filter(list_transform(regexp_extract_all(lower({t}), '[a-z0-9]+'), lambda t: {synonyms}), lambda t: NOT list_contains({_LIST(scoring.STOPWORDS)}, t)))"


def relevance_sql(question: str, answer: str) -> str:
    n = f"len(list_intersect({_content(question)}, {_content(answer)}))"
    return f"CASE {n} WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 4 ELSE 5 END"


def tone_sql(question: str, answer: str) -> str:
    low = f"lower(regexp_replace({answer}, '^\\s+|\\s+$', '', 'g'))"
    words = lambda t: f"len(regexp_extract_all({t}, '[\\p{{L}}\\p{{N}}_]+'))"
    n, asked = words(low), words(f"lower({question})")
    rude = r"you'?re\s+trash|that'?s?\s+trash|stupid|idiot|moron|dumb|shut\s+up"
    # marks are doubled, white space within a phrase as well
    rude = f"regexp_matches({apart(low)}, {q('[^\\p{L}\\p{N}_](?:' + rude.replace("'?", "(?:\\'\\')?").replace("\\'", "''"[0]) + ')[^\\p{L}\\p{N}_]')})"
    starts = f"len(list_filter(string_split_regex({low}, '[.!?]\\s+'), lambda s: regexp_matches(ltrim(s), '^(?:obviously|simply|basically)'))) > 0"
    polite, empathy = _COUNT(low, scoring.POLITE), _COUNT(low, scoring.EMPATHY)
    return f"""CASE WHEN {low} = '' THEN 1 WHEN {_LIKE(low, (*scoring.BLAME, *scoring.PUSHY, *scoring.CONDESCENDING))} THEN 1
      WHEN {starts} THEN 1 WHEN {_LIKE(low, scoring.DISMISSIVE)} THEN 2
      WHEN {n} < 10 AND {asked} > 15 AND NOT {_LIKE(low, scoring.SOOTHING)} THEN 2 WHEN {rude} THEN 1
      WHEN {empathy} >= 1 AND {polite} >= 1 AND {n} > 30 THEN 5 WHEN {polite} >= 2 AND {n} > 20 THEN 5
      WHEN {polite} >= 1 AND {n} > 20 THEN 4 WHEN {empathy} >= 1 OR {polite} >= 1 THEN 4 WHEN {n} > 25 THEN 4 ELSE 3 END"""


def nonsense_hits(answer: str) -> dict[str, str]:
    t = f"trim({answer})"
    toks = f"regexp_extract_all({t}, '[A-Za-z]{{2,}}')"
    low = "lower(x)"
    bad = f"len(list_filter({toks}, lambda x: regexp_matches({low}, '^[^aeiou]+$') OR len(regexp_replace({low}, '[^aeiou]', '', 'g'))::DOUBLE / len(x) < 0.20 OR regexp_matches({low}, '[^aeiou]{{6,}}')))"
    # RE2 has no backreference: a run of each character up to Latin Extended-A.
    run = f"regexp_matches({t}, '" + "|".join(rf"\x{{{c:x}}}{{6,}}" for c in (9, 10, 13, *range(32, 0x180))) + "')"
    return {
        "alpha": ratio(f"length(regexp_replace({t}, '[^\\p{{L}}]', '', 'g'))", f"length({t})"),
        "words": f"len(regexp_extract_all({t}, '[\\p{{L}}\\p{{N}}_]+'))",
        "run": f"({run})",
        "gibberish": f"CASE WHEN len({toks}) = 0 THEN 1.0 ELSE {ratio(bad, f'len({toks})')} END",
    }


def nonsense_sql(answer: str) -> str:
    s = nonsense_hits(answer)
    hits = f"(({s['alpha']} < 0.55)::INT + ({s['words']} < 3)::INT + {s['run']}::INT + ({s['gibberish']} >= 0.55)::INT)"
    return f"CASE WHEN trim({answer}) = '' THEN NULL WHEN {hits} >= 2 THEN 'strong' WHEN {hits} = 1 THEN 'weak' END"


def repetition_parts(answer: str) -> dict[str, str]:
    lines = f"list_filter(list_transform(string_split_regex(lower({answer}), '\\r?\\n+'), lambda x: trim(x)), lambda x: x <> '')"
    toks = f"regexp_extract_all(lower({answer}), '[a-z0-9]+')"
    return {"lines": lines, "toks": toks}


#: Lines and trigrams counted by grouping, not by sorting.
REPETITION = f"""r0 AS (SELECT key, answer, {repetition_parts('answer')['lines']} AS lines, {repetition_parts('answer')['toks']} AS toks FROM src),
r1 AS (SELECT key, sum(CASE WHEN n > 1 THEN n ELSE 0 END)::DOUBLE / sum(n) AS dup FROM (SELECT key, l, count(*) AS n FROM r0, unnest(lines) AS t(l) GROUP BY key, l) GROUP BY key),
r2 AS (SELECT key, count(*) FILTER (n >= 3) AS reps FROM (
  SELECT key, g, count(*) AS n FROM (SELECT key, toks[i::BIGINT] || ' ' || toks[(i + 1)::BIGINT] || ' ' || toks[(i + 2)::BIGINT] AS g FROM r0, unnest(generate_series(1, len(toks) - 2)) AS t(i)) GROUP BY key, g) GROUP BY key),
rep AS (SELECT r0.key, coalesce(dup, 0.0) AS duplicate_line_ratio, coalesce(reps, 0)::BIGINT AS repeated_ngrams, len(toks)::BIGINT AS tokens,
  len(list_distinct(toks))::DOUBLE / greatest(1, len(toks)) AS unique_ratio, trim(answer) = '' AS blank FROM r0 LEFT JOIN r1 USING (key) LEFT JOIN r2 USING (key)),
repetition AS (SELECT *, CASE WHEN blank THEN NULL WHEN NOT (duplicate_line_ratio >= 0.35 OR repeated_ngrams > 0 OR (tokens >= 8 AND unique_ratio <= 0.4)) THEN NULL
  WHEN duplicate_line_ratio >= 0.35 * 1.5::DOUBLE OR repeated_ngrams >= 2 OR unique_ratio <= 0.4 THEN 'strong' ELSE 'weak' END AS severity FROM rep)"""


def score_ctes(cases: str, key: str) -> str:
    """CTEs that end in ``scored``: the rubric score of (key, question, answer), for cases that ask for no definition."""
    return f"""{cases}, src AS (SELECT {key} AS key, question, answer FROM {cases.split(' ')[0] if ' AS (' in cases else cases}),
{REPETITION},
s0 AS (SELECT src.key, answer, {relevance_sql('question', 'answer')} AS r, {tone_sql('question', 'answer')} AS t,
  CASE WHEN trim(answer) = '' THEN 1 WHEN length(trim(answer)) < 10 THEN 3 ELSE 4 END AS c,
  CASE WHEN trim(lower(answer)) = '' THEN 1 WHEN {_LIKE('lower(answer)', scoring.HEDGES)} THEN 2 ELSE 4 END AS k,
  {nonsense_sql('answer')} AS ns, severity AS rs FROM src JOIN repetition USING (key)),
s1 AS (SELECT *, coalesce(ns = 'strong', false) AS nonsense, coalesce(rs = 'strong', false) AS repeats, (r + c + k + t)::DOUBLE / 4 AS overall_score FROM s0),
scored AS (SELECT key, overall_score,
  CASE WHEN overall_score < 3.0 OR least(r, c, k, t) <= 1 OR nonsense OR repeats THEN 'fail' ELSE 'pass' END AS decision,
  CASE WHEN nonsense OR repeats THEN least(r, 2) ELSE r END AS relevance,
  CASE WHEN nonsense OR repeats THEN 1 WHEN ns IS NOT NULL OR rs IS NOT NULL THEN least(c, 2) ELSE c END AS clarity,
  CASE WHEN nonsense THEN 1 ELSE k END AS correctness, t AS tone,
  CASE k WHEN 1 THEN 0.9 WHEN 2 THEN 0.65 ELSE 0.7 END::DOUBLE AS confidence,
  list_filter([CASE WHEN r <= 2 THEN 'low_relevance' END, CASE WHEN t <= 2 THEN 'rude_tone' END, 'quality.nonsense_basic:' || ns, 'quality.repetition_basic:' || rs], lambda x: x IS NOT NULL) AS flags FROM s1)"""


PAIR_SCORES = score_ctes(PAIRS + ", keyed AS (SELECT conv_id * 1000 + turn AS key, * FROM pairs)", "key").replace("FROM pairs),\nr0", "FROM keyed),\nr0")
DOC_SCORES = score_ctes(DOCUMENT_CASES, "doc_id")


@query("relevance", f"WITH {PAIRS} SELECT conv_id, turn, {relevance_sql('question', 'answer')} AS relevance FROM pairs")
def _(spark, d):
    return pairs(spark, d).select("conv_id", "turn", scoring.relevance(F.col("question"), F.col("answer")).alias("relevance"))


@query("tone", f"WITH {DOCUMENT_CASES} SELECT doc_id, {tone_sql('question', 'answer')} AS tone FROM cases")
def _(spark, d):
    return document_cases(spark, d).select("doc_id", scoring.tone(F.col("question"), F.col("answer")).alias("tone"))


@query("rubric_score", f"WITH {DOC_SCORES} SELECT key AS doc_id, decision, overall_score, relevance, clarity, correctness, tone, confidence, array_to_string(flags, ',') AS flags FROM scored")
def _(spark, d):
    s = scoring.score(document_cases(spark, d))
    return s.select("doc_id", "decision", "overall_score", *scoring.DIMENSIONS, "confidence", F.array_join("flags", ",").alias("flags"))


_N = nonsense_hits("text")


@query("rule_nonsense", f"SELECT doc_id, {_N['alpha']} AS alpha_ratio, {_N['words']}::BIGINT AS word_count, {_N['run']} AS char_run, {_N['gibberish']} AS gibberish_ratio, {nonsense_sql('text')} AS severity FROM documents")
def _(spark, d):
    s = rules.nonsense_signals(F.col("text"))
    s["word_count"] = s["word_count"].cast("long")
    return table(spark, d, "documents").select("doc_id", *[v.alias(k) for k, v in s.items()], rules.nonsense(F.col("text"), F.col("text")).alias("severity"))


@query("rule_repetition", f"WITH src AS (SELECT doc_id AS key, text AS answer FROM documents), {REPETITION} SELECT key AS doc_id, duplicate_line_ratio, repeated_ngrams, tokens, unique_ratio, severity FROM repetition")
def _(spark, d):
    s = {k: v if k.endswith("ratio") else v.cast("long") for k, v in rules.repetition_signals(F.col("text")).items()}
    return table(spark, d, "documents").select("doc_id", *[v.alias(k) for k, v in s.items()], rules.repetition(F.col("text"), F.col("text")).alias("severity"))


@query(
    "rule_math",
    """WITH m AS (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS a, l_linenumber - 4 AS b, ['+', '-', '*', '/', '%'][1 + l_orderkey % 5] AS op, l_orderkey % 7 = 0 AS wrong FROM lineitem),
  v AS (SELECT *, CASE op WHEN '+' THEN a + b WHEN '-' THEN a - b WHEN '*' THEN a * b WHEN '/' THEN a::DOUBLE / nullif(b, 0) ELSE a - b * floor(a::DOUBLE / nullif(b, 0)) END AS value FROM m)
  SELECT l_orderkey, l_linenumber, value IS NOT NULL AND wrong AS math_incorrect FROM v""",
)
def _(spark, d):
    a, b = F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long") - 4
    op = F.element_at(F.array(*map(F.lit, "+-*/%")), (F.col("l_orderkey") % 5 + 1).cast("int"))
    value = F.when(op == "+", a + b).when(op == "-", a - b).when(op == "*", a * b).when(op == "%", a - b * F.floor(F.try_divide(a.cast("double"), b)))
    said = F.when(op == "/", F.try_divide(a.cast("double"), b)).otherwise(value) + F.when(F.col("l_orderkey") % 7 == 0, 1).otherwise(0)
    digits = F.when(op == "/", F.format_string("%.12f", said.cast("double"))).otherwise(said.cast("long").cast("string"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws(" ", F.lit("What is"), a.cast("string"), op, b.cast("string")).alias("q"), F.concat(F.lit("It is "), F.coalesce(digits, F.lit("undefined"))).alias("a"))
    return rows.select("l_orderkey", "l_linenumber", F.coalesce(rules.arithmetic_wrong(F.col("q"), F.col("a")), F.lit(False)).alias("math_incorrect"))


@query("rule_definition")
def _(spark, d):
    """Definitions asked of documents' first words, circular for every third."""
    word = F.split_part("text", F.lit(" "), F.lit(1))
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.lit("What is "), word, F.lit("?")).alias("q"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("a thing is a thing and "), word)).otherwise(F.col("text")).alias("a"))
    return rows.select("doc_id", rules.definition(F.col("q"), F.col("a")).alias("severity"))


@query(
    "rule_detectors",
    """SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 3 = 0 AND NOT contains(lower(a), 'paris') THEN 'correctness.known_fact_mismatch' END,
  CASE WHEN doc_id % 5 = 0 AND len(list_intersect(qk, ak))::DOUBLE / len(qk) < 0.15 THEN 'correctness.nonsense_detected' END,
  CASE WHEN doc_id % 7 = 0 THEN 'correctness.unsafe_advice' END], lambda x: x IS NOT NULL), ',') AS flags
  FROM (SELECT doc_id, text AS a, list_distinct(regexp_extract_all(lower(CASE WHEN doc_id % 3 = 0 THEN 'Name the capital of France ' ELSE 'Tell me ' END), '[a-z]{3,}')) AS qk,
    list_distinct(regexp_extract_all(lower(text || CASE WHEN doc_id % 5 = 0 THEN ' bananas' ELSE '' END || CASE WHEN doc_id % 7 = 0 THEN ' use the microwave' ELSE '' END), '[a-z]{3,}')) AS ak FROM documents)""",
)
def _(spark, d):
    i = F.col("doc_id")
    question = F.when(i % 3 == 0, "Name the capital of France ").otherwise("Tell me ")
    answer = F.concat("text", F.when(i % 5 == 0, " bananas").otherwise(""), F.when(i % 7 == 0, " use the microwave").otherwise(""))
    rows = table(spark, d, "documents").select("doc_id", question.alias("q"), answer.alias("a"))
    return rows.select("doc_id", F.array_join(rules.detectors(F.col("q"), F.col("a")), ",").alias("flags"))


def judged(spark, d):
    """Documents with labels, scored: the fact table of a run."""
    cases = document_cases(spark, d).join(human_labels(spark, d), "doc_id")
    return scoring.score(cases).withColumnRenamed("decision", "judge_decision")


JUDGED = f"{DOC_SCORES}, {HUMAN}, judged AS (SELECT doc_id, decision AS judge_decision, human_decision, overall_score, relevance, clarity, correctness, tone, flags, lang, source FROM scored JOIN human ON key = doc_id JOIN documents USING (doc_id))"
_CELLS = """c AS (SELECT count(*) AS n_total, count(*) FILTER (human_decision = 'pass' AND judge_decision = 'pass') AS pp, count(*) FILTER (human_decision = 'pass' AND judge_decision = 'fail') AS pf,
  count(*) FILTER (human_decision = 'fail' AND judge_decision = 'pass') AS fp, count(*) FILTER (human_decision = 'fail' AND judge_decision = 'fail') AS ff FROM judged)"""
_F1 = lambda p, r: f"coalesce(2 * ({p}) * ({r}) / nullif(({p}) + ({r}), 0), 0.0)"
_PF, _RF, _PP, _RP = ratio("ff", "ff + pf"), ratio("ff", "ff + fp"), ratio("pp", "pp + fp"), ratio("pp", "pp + pf")
_KAPPA = "(SELECT (p0 - pe) / nullif(1 - pe, 0) FROM (SELECT (pp + ff)::DOUBLE / nullif(n_total::DOUBLE, 0) AS p0, ((pp + pf) * (pp + fp) + (fp + ff) * (pf + ff))::DOUBLE / nullif(n_total::DOUBLE * n_total::DOUBLE, 0) AS pe))"


@query(
    "classification_metrics",
    f"WITH {JUDGED}, {_CELLS} SELECT n_total, n_total AS n_scored, (pp + ff)::DOUBLE / n_total AS accuracy, {_KAPPA} AS cohen_kappa, {_PF} AS precision_fail, {_RF} AS recall_fail, {_PP} AS precision_pass, {_RP} AS recall_pass, {_F1(_PF, _RF)} AS f1_fail, {_F1(_PP, _RP)} AS f1_pass FROM c",
)
def _(spark, d):
    return metrics.bundle(judged(spark, d))


@query("cohen_kappa", f"WITH {JUDGED}, {_CELLS} SELECT {_KAPPA} AS kappa FROM c")
def _(spark, d):
    return metrics.bundle(judged(spark, d)).select(F.col("cohen_kappa").alias("kappa"))


_CONFUSION = "count(*) FILTER (human_decision = 'fail' AND judge_decision = 'fail') AS tp, count(*) FILTER (human_decision = 'pass' AND judge_decision = 'fail') AS fp, count(*) FILTER (human_decision = 'fail' AND judge_decision = 'pass') AS fn, count(*) FILTER (human_decision = 'pass' AND judge_decision = 'pass') AS tn"


@query("confusion_matrix", f"WITH {JUDGED} SELECT lang, {_CONFUSION} FROM judged GROUP BY lang")
def _(spark, d):
    return metrics.confusion(judged(spark, d), "human_decision", "judge_decision", ("lang",))


@query(
    "metrics_by_slice",
    f"WITH {JUDGED}, l AS (SELECT 'all' AS slice, 'all' AS value, * FROM judged UNION ALL SELECT 'lang', lang, * FROM judged UNION ALL SELECT 'source', source, * FROM judged), c AS (SELECT slice, value, {_CONFUSION} FROM l GROUP BY slice, value) SELECT slice, value, tp, fp, fn, tn, {rates()} FROM c",
)
def _(spark, d):
    return metrics.by_slice(judged(spark, d), "human_decision", "judge_decision", ("lang", "source"))


@query("rule_hit_rates", f"WITH {JUDGED}, f AS (SELECT unnest(flags) AS flag FROM judged) SELECT split_part(flag, ':', 1) AS rule, count(*) AS hits, count(*)::DOUBLE / (SELECT count(*) FROM judged)::DOUBLE AS rate FROM f GROUP BY 1")
def _(spark, d):
    return metrics.hit_rates(judged(spark, d))


@query(
    "calibration",
    f"""WITH {JUDGED}, h AS (SELECT j.*, CASE WHEN human_decision = 'pass' THEN 4 ELSE 2 END AS h FROM judged j),
  l AS (SELECT 'clarity' AS dimension, h, clarity AS j FROM h UNION ALL SELECT 'tone', h, tone FROM h UNION ALL SELECT 'relevance', h, relevance FROM h)
  SELECT dimension, count(*) AS n, (count(*) FILTER (abs(j - h) <= 1))::DOUBLE / count(*)::DOUBLE AS within_one, (count(*) FILTER (j = h))::DOUBLE / count(*)::DOUBLE AS exact, sum(j - h)::DOUBLE / count(*)::DOUBLE AS mean_delta FROM l GROUP BY dimension""",
)
def _(spark, d):
    rows = judged(spark, d).withColumn("h", F.when(F.col("human_decision") == "pass", 4).otherwise(2))
    return metrics.calibration(rows, {x: ("h", x) for x in ("clarity", "tone", "relevance")})


_AGREE = """count(*) AS n, count(*) FILTER (j = h) AS exact, count(*) FILTER (abs(j - h) <= 1) AS within_1, count(*) FILTER (abs(j - h) <= 2) AS within_2,
  count(*) FILTER (j > h) AS higher, count(*) FILTER (j < h) AS lower, CASE WHEN 100.0 * count(*) FILTER (abs(j - h) <= 1) / count(*) >= 70 THEN 'validated' WHEN 100.0 * count(*) FILTER (abs(j - h) <= 1) / count(*) >= 50 THEN 'developing' ELSE 'experimental' END AS tier"""


def _scores(spark, d):
    return judged(spark, d).select("source", F.when(F.col("human_decision") == "pass", 4).otherwise(2).alias("h"), F.col("tone").alias("j"))


_SCORES = f"{JUDGED}, l AS (SELECT source, CASE WHEN human_decision = 'pass' THEN 4 ELSE 2 END AS h, tone AS j FROM judged)"


@query("dimension_agreement", f"WITH {_SCORES} SELECT source, {_AGREE} FROM l GROUP BY source")
def _(spark, d):
    return metrics.agreement(_scores(spark, d), "h", "j", ("source",))


@query("feedback_bias", f"WITH {_SCORES}, a AS (SELECT source, {_AGREE} FROM l GROUP BY source) SELECT source, n, higher, lower, CASE WHEN n < 3 THEN 'insufficient' WHEN higher > 1.5 * lower THEN 'lenient' WHEN lower > 1.5 * higher THEN 'strict' ELSE 'balanced' END AS bias FROM a")
def _(spark, d):
    return metrics.bias_direction(metrics.agreement(_scores(spark, d), "h", "j", ("source",))).select("source", "n", "higher", "lower", "bias")


@query("dimension_mae", f"WITH {_SCORES} SELECT sum(abs(coalesce(j, 3) - h))::DOUBLE / count(*)::DOUBLE AS mae, count(*) AS cases FROM l")
def _(spark, d):
    n = F.count(F.lit(1))
    return _scores(spark, d).agg((F.sum(F.abs(F.coalesce("j", F.lit(3)) - F.col("h"))).cast("double") / n.cast("double")).alias("mae"), n.alias("cases"))


@query("gate_winner", f"WITH {_SCORES} SELECT CASE WHEN abs(j - h) < abs(3 - h) THEN 'judge' WHEN abs(j - h) > abs(3 - h) THEN 'default' ELSE 'tie' END AS winner, count(*) AS n FROM l GROUP BY 1")
def _(spark, d):
    mine, other = F.abs(F.col("j") - F.col("h")), F.abs(3 - F.col("h"))
    return _scores(spark, d).groupBy(F.when(mine < other, "judge").when(mine > other, "default").otherwise("tie").alias("winner")).agg(F.count(F.lit(1)).alias("n"))


@query("length_bias", f"WITH {JUDGED}, l AS (SELECT length(text) AS x, (relevance + clarity + correctness + tone)::BIGINT AS y FROM judged JOIN documents USING (doc_id)), s AS (SELECT count(*)::DOUBLE AS n, sum(x)::DOUBLE AS sx, sum(y)::DOUBLE AS sy, sum(x * y)::DOUBLE AS sxy, sum(x * x)::DOUBLE AS sxx, sum(y * y)::DOUBLE AS syy FROM l) SELECT CASE WHEN n * sxx - sx * sx > 0 AND n * syy - sy * sy > 0 THEN (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) ELSE 0.0 END AS correlation, n::BIGINT AS n FROM s")
def _(spark, d):
    from plumbline.operators import robustness

    return robustness.length_correlation(judged(spark, d), F.length("answer").cast("long"), (F.col("relevance") + F.col("clarity") + F.col("correctness") + F.col("tone")).cast("long"))


@query("length_flag_corr", f"WITH {JUDGED}, l AS (SELECT length(text) AS x, len(flags)::BIGINT AS y FROM judged JOIN documents USING (doc_id)), s AS (SELECT count(*)::DOUBLE AS n, sum(x)::DOUBLE AS sx, sum(y)::DOUBLE AS sy, sum(x * y)::DOUBLE AS sxy, sum(x * x)::DOUBLE AS sxx, sum(y * y)::DOUBLE AS syy FROM l) SELECT CASE WHEN n * sxx - sx * sx > 0 AND n * syy - sy * sy > 0 THEN (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) ELSE 0.0 END AS correlation, n::BIGINT AS n FROM s")
def _(spark, d):
    from plumbline.operators import robustness

    return robustness.length_correlation(judged(spark, d), F.length("answer").cast("long"), F.size("flags").cast("long"))


@query("human_routing", f"WITH {JUDGED} SELECT doc_id FROM judged WHERE CASE WHEN correctness = 2 THEN 0.65 ELSE 0.7 END < 0.6 OR len(list_filter(flags, lambda f: contains(f, 'nonsense'))) > 0")
def _(spark, d):
    from plumbline.operators import robustness

    return judged(spark, d).where(robustness.needs_human(F.col("confidence"), F.col("flags"), ("nonsense",))).select("doc_id")


@query("gate_escalation", f"WITH {JUDGED} SELECT doc_id FROM judged WHERE len(list_filter(flags, lambda f: starts_with(f, 'quality.') OR starts_with(f, 'correctness.'))) = 0 AND least(relevance, clarity, correctness, tone) >= 3 AND greatest(relevance, clarity, correctness, tone) <= 4 AND overall_score BETWEEN 2.5 AND 3.8")
def _(spark, d):
    from plumbline.operators import robustness

    return judged(spark, d).where(robustness.undecided(F.col("flags"), F.col("overall_score"), [F.col(x) for x in scoring.DIMENSIONS])).select("doc_id")


@query("sentence_split", r"SELECT doc_id, pos, s AS sentence FROM (SELECT doc_id, s, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, l, unnest(l) AS s FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: length(s) > 10) AS l FROM documents)))".replace("generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, l, unnest(l) AS s FROM", "pos FROM (SELECT doc_id, unnest(l) AS s, unnest(range(len(l)))::INT AS pos FROM"))
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


@query("rule_flags", f"WITH src AS (SELECT doc_id AS key, text AS answer FROM documents), {REPETITION} SELECT key AS doc_id, array_to_string(list_filter(['quality.nonsense_basic:' || {nonsense_sql('answer')}, 'quality.repetition_basic:' || severity], lambda x: x IS NOT NULL), ',') AS flags FROM src JOIN repetition USING (key)")
def _(spark, d):
    plan = ("quality.nonsense_basic", "unknown.rule", "quality.repetition_basic")
    return table(spark, d, "documents").select("doc_id", F.array_join(rules.flags(F.lit(""), F.col("text"), plan), ",").alias("flags"))
