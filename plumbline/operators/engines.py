"""Judges as strategies, the gate that trusts them, and the chain of capabilities that evaluates a case.

A judge is a function from cases to cases with decision, overall_score, confidence and flags. Failures are rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import providers, scoring

Judge = Callable[[DataFrame], DataFrame]

#: Judges by name; an application adds its own.
JUDGES: dict[str, Callable[..., Judge]] = {}


def register_judge(name: str) -> Callable:
    """Adds a maker of judges under ``name``; a name is taken once."""

    def add(make: Callable[..., Judge]) -> Callable[..., Judge]:
        if name in JUDGES:
            raise ValueError(f"judge {name} is there already")
        JUDGES[name] = make
        return make

    return add


@register_judge("deterministic")
def deterministic(*, question: str = "question", answer: str = "answer") -> Judge:
    """The rubric in Columns. It is sure where no dimension stands at the edge of its band, and doubtful otherwise."""

    def judge(cases: DataFrame) -> DataFrame:
        scored = scoring.score(cases, question=question, answer=answer)
        doubt = F.col("overall_score").between(2.5, 3.8)
        out = scored.select(*cases.columns, "decision", "overall_score", F.when(doubt, 0.5).otherwise(0.9).alias("confidence"), F.col("flags"))
        return out.withColumn("engine", F.lit("deterministic"))

    return judge


@register_judge("fallback")
def fallback(*, primary: Judge, second: Judge) -> Judge:
    """``primary``, whose rows may have an ``error``; those are judged by ``second`` instead."""

    def judge(cases: DataFrame) -> DataFrame:
        found = primary(cases)
        failed = F.col("error").isNotNull()
        again = second(found.where(failed).select(*cases.columns))
        return found.where(~failed).drop("error").unionByName(again)

    return judge


@register_judge("sequential")
def sequential(*, gate1: Judge, gate2: Judge, doubtful: Column | None = None) -> Judge:
    """``gate1`` on all, ``gate2`` on the doubtful ones alone; where that errs, what ``gate1`` said stays."""

    def judge(cases: DataFrame) -> DataFrame:
        seen = gate1(cases)
        doubt = F.col("confidence") < 0.6 if doubtful is None else doubtful
        results = [c for c in seen.columns if c not in cases.columns]

        def second(rows: DataFrame) -> DataFrame:
            first = rows.select(*cases.columns, F.struct(*results).alias("_first"))
            found = gate2(first.select(*cases.columns, "_first"))
            error = F.col("error").isNotNull() if "error" in found.columns else F.lit(False)
            kept = {c: F.when(error, F.col("_first")[c]).otherwise(F.col(c)) if c in found.columns else F.col("_first")[c] for c in results}
            return found.select(*cases.columns, *[v.alias(c) for c, v in kept.items()])

        return providers.escalate(seen, doubt, second)

    return judge


@register_judge("debiased")
def debiased(*, judge: Judge, key: Sequence[str], times: int = 3) -> Judge:
    """The majority of ``times`` evaluations of each case, the mean of its scores, and whether they disagree."""

    def run(cases: DataFrame) -> DataFrame:
        votes = judge(cases.withColumn("_vote", F.explode(F.sequence(F.lit(1), F.lit(times)))))
        passes, n = F.count_if(F.col("decision") == "pass"), F.count(F.lit(1))
        by = votes.groupBy(*key).agg(
            F.when(2 * passes > n, "pass").otherwise("fail").alias("decision"), F.avg("overall_score").alias("overall_score"),
            F.avg("confidence").alias("confidence"), F.when((passes > 0) & (passes < n), F.array(F.lit("disagreement"))).otherwise(F.array().cast("array<string>")).alias("flags"),
        )
        return cases.join(by.withColumn("engine", F.lit("debiased")), list(key))

    return run


@register_judge("calibrated")
def calibrated(*, judge: Judge, allowed: bool, reason: str = "") -> Judge:
    """``judge`` if the trust gate allows it; else no decision, and the reason as a flag."""

    def run(cases: DataFrame) -> DataFrame:
        if allowed:
            return judge(cases)
        nothing = {"decision": F.lit(None).cast("string"), "overall_score": F.lit(None).cast("double"), "confidence": F.lit(0.0), "flags": F.array(F.lit(f"trust_gate:{reason}")), "engine": F.lit("calibrated")}
        return cases.withColumns(nothing)

    return run


@register_judge("integrated")
def integrated(*, model: Callable[[DataFrame], DataFrame], checks: Mapping[str, Column], retrieve: Callable[[DataFrame], DataFrame] | None = None) -> Judge:
    """Retrieval, then checks of properties, then the model, then what the checks say about its decision.

    ``checks`` are decisions (pass or fail) by property; one that fails turns a pass into a fail and
    stands in ``evidence``. ``model`` adds decision, overall_score, confidence and flags.
    """

    def run(cases: DataFrame) -> DataFrame:
        rows = retrieve(cases) if retrieve else cases
        evidence = F.map_from_arrays(F.array(*map(F.lit, checks)), F.array(*checks.values()))
        seen = model(rows.withColumn("evidence", evidence))
        failed = F.map_keys(F.map_filter("evidence", lambda _, v: v == "fail"))
        flags = F.array_union(F.col("flags"), F.transform(failed, lambda k: F.concat(F.lit("property."), k)))
        decision = F.when((F.col("decision") == "pass") & (F.size(failed) > 0), "fail").otherwise(F.col("decision"))
        return seen.withColumns({"flags": flags, "decision": decision, "engine": F.lit("integrated")})

    return run


def judge_engine(name: str, **settings) -> Judge:
    """The judge of this name, as a setting chooses it."""
    if name not in JUDGES:
        raise ValueError(f"judge {name!r} is not one of {sorted(JUDGES)}")
    return JUDGES[name](**settings)


def low_confidence_tagged(rows: DataFrame, least: float = 0.6) -> DataFrame:
    """``rows`` with the flag low_confidence, once, where the confidence is under ``least``."""
    tagged = F.array_union(F.col("flags"), F.array(F.lit("low_confidence")))
    return rows.withColumn("flags", F.when(F.col("confidence") < least, tagged).otherwise(F.col("flags")))


def trusted(judges: DataFrame, calibrations: DataFrame, enforce: bool) -> DataFrame:
    """(judge_id, allowed, reason) of judges (judge_id, engine, status), by their latest calibration (judge_id, at, passed).

    A deterministic judge needs none. A blocked or unknown one is refused. A calibrated one needs a
    latest result that passed, others have none; where the gate is not enforced those go through, with a warning.
    """
    latest = calibrations.groupBy("judge_id").agg(F.max_by("passed", F.struct("at", "passed")).alias("passed"))
    j = judges.join(latest, "judge_id", "left")
    status, passed = F.col("status"), F.coalesce("passed", F.lit(False))
    open_ = F.lit(not enforce)
    allowed = F.when(F.col("engine") == "deterministic", True).when(status == "calibrated", passed | open_).when(status.isin("registered", "calibrating"), open_).otherwise(False)
    reason = (
        F.when(F.col("engine") == "deterministic", "deterministic").when(status == "blocked", "blocked")
        .when((status == "calibrated") & passed, "calibrated").when(status == "calibrated", F.lit("unverified" if enforce else "unverified, not enforced"))
        .when(status.isin("registered", "calibrating"), F.lit("uncalibrated" if enforce else "uncalibrated, not enforced")).otherwise("unknown status")
    )
    return j.select("judge_id", F.coalesce(allowed, F.lit(False)).alias("allowed"), reason.alias("reason"))


@dataclass(frozen=True)
class Capability:
    """A step of the chain: ``run`` adds ``output``, ``error`` and ``duration_ms`` to cases; ``after`` names steps whose failure skips it."""

    name: str
    run: Callable[[DataFrame], DataFrame]
    timeout_s: float
    after: tuple[str, ...] = ()


#: The chain's order and its limits in seconds.
CHAIN = (("CAP-1", 5.0, ()), ("CAP-2", 5.0, ("CAP-1",)), ("CAP-7", 30.0, ("CAP-1",)), ("CAP-5", 5.0, ()))


@dataclass
class Chain:
    """Capabilities in order over all cases at once; a case's failure is in its row and stops no other case."""

    capabilities: Sequence[Capability]
    guards: Sequence[Callable[[Column, Column], Column]] = field(default_factory=tuple)

    def run(self, cases: DataFrame) -> DataFrame:
        """``cases`` with outputs (a map, of the steps that succeeded), integrity (an array of records in the chain's order) and complete.

        A step that has no output for a case is absent from its map, which is not the same as an empty
        output. Guards look at (duration_ms, limit) after a step and may deny what has run; they cancel nothing.
        """
        columns, state = cases.columns, cases.withColumns({"outputs": F.create_map().cast("map<string,string>"), "integrity": F.array().cast("array<struct<capability:string,status:string,error:string,duration_ms:double>>")})
        for step in self.capabilities:
            failed = F.exists("integrity", lambda r: r["capability"].isin(*step.after) & (r["status"] != "success")) if step.after else F.lit(False)
            skipped, ready = state.where(failed), state.where(~failed)
            record = lambda status, error, ms: F.array_append("integrity", F.struct(F.lit(step.name).alias("capability"), status.alias("status"), error.cast("string").alias("error"), ms.cast("double").alias("duration_ms")))  # noqa: E731, B023
            none = F.lit(None)
            skipped = skipped.withColumn("integrity", record(F.lit("skipped"), none, none))
            seen = step.run(ready)
            denied = F.lit(False)
            for guard in self.guards:
                denied = denied | guard(F.col("duration_ms"), F.lit(step.timeout_s))
            status = F.when(F.col("error").isNotNull(), "failure").when(denied, "denied").otherwise("success")
            outputs = F.when(status == "success", F.map_concat("outputs", F.create_map(F.lit(step.name), F.col("output")))).otherwise(F.col("outputs"))
            seen = seen.withColumns({"outputs": outputs, "integrity": record(status, F.col("error"), F.col("duration_ms"))})
            state = skipped.unionByName(seen.drop("output", "error", "duration_ms"))
        complete = F.forall("integrity", lambda r: r["status"] == "success")
        return state.select(*columns, "outputs", "integrity", complete.alias("complete"))


def timeout_guard(duration_ms: Column, limit_s: Column) -> Column:
    """Denies a step that took longer than its limit, after it has completed."""
    return F.coalesce(duration_ms > limit_s * 1000, F.lit(False))


def case_id(request_id: Column, position: Column) -> Column:
    """A case's request id, or case_0000 on by its position in its batch."""
    blank = F.coalesce(F.trim(request_id) == "", F.lit(True))
    return F.when(blank, F.format_string("case_%04d", position)).otherwise(request_id)


#: Plans for rubrics that bring none.
DEFAULT_PLAN = ("quality.nonsense_basic", "quality.repetition_basic", "correctness.definition_sanity", "correctness.basic")


def resolved_plan(rubric: str, plans: Mapping[str, Sequence[Mapping]], inline: Sequence[Mapping] | None = None, governance: Mapping[str, str] | None = None) -> list[str]:
    """The rules of a rubric: those of the configured plan, else of the inline one, else the default.

    Rules that are disabled, or that governance calls deprecated and enforces, are left out.
    """
    rules = plans.get(rubric) or inline or [{"id": r} for r in DEFAULT_PLAN]
    status = governance or {}
    return list(dict.fromkeys(r["id"] for r in rules if r.get("enabled", True) and status.get(r["id"]) != "deprecated"))


def prompt_difference(before: Mapping, after: Mapping) -> dict[str, list[str]]:
    """Fields of two prompts that changed, and dimensions that came or went."""
    fields = sorted(k for k in {*before, *after} - {"dimensions"} if before.get(k) != after.get(k))
    old, new = set(before.get("dimensions", ())), set(after.get("dimensions", ()))
    return {"changed": fields, "added": sorted(new - old), "removed": sorted(old - new)}


def last_message(conversation: Column) -> Column:
    """The content of a conversation's last message, empty if there is none."""
    return F.coalesce(F.try_element_at(conversation, F.lit(-1))["content"], F.lit(""))


def request_source(source_context: Column, conversation: Column, answer: Column) -> Column:
    """A case's source: its contexts, else the last user message (the first message if no user speaks), else the answer."""
    joined = F.when(F.size(source_context) > 0, F.array_join(F.filter(source_context, lambda s: F.coalesce(s != "", F.lit(False))), "\n\n"))
    users = F.filter(conversation, lambda m: m["role"] == "user")
    said = F.coalesce(F.try_element_at(users, F.lit(-1))["content"], F.get(conversation, 0)["content"])
    return F.coalesce(F.nullif(F.coalesce(joined, said), F.lit("")), answer)
