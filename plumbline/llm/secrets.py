"""Operator 9: secrets, by fixed patterns and by a battery of randomness tests.

The patterns are assignments to telling names, access keys and long hexadecimal runs. The
battery looks at every other run of at least ``LEAST`` characters of the usual encodings
that has both letters and digits. The run's encoding is inferred from its characters, and
three tests hold it against uniform random draws from that alphabet: a chi-squared test of
the characters' counts, a runs test about the middle of the alphabet, and a test of the
correlation of each character with the next. Fisher's method combines their p-values.

Strings that are not random, such as words, paths and counters, get small ones. They are
told apart by the Benjamini-Hochberg rule among all runs of like length and encoding, as the
tests see far more in long strings than in short ones: in each such stratum at most a share
``alpha`` of what is set aside as not random is expected to be random. What is not set aside
is reported. P-values are compared on a logarithmic scale with fixed steps, so that the rule
needs only counts for each step. All of it is DataFrame operations in one pass over the
texts; a text's spans never leave its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import cut

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
#: Shortest run that the battery looks at: with fewer characters it can't tell words from random ones.
LEAST = 20
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}={0,2}" % LEAST
KINDS = ("assign", "access", "hex", "random")
#: Alphabets by the order in which they are tried; the first that holds all characters is inferred.
ALPHABETS = {
    "hex": ("^[0-9a-f]+$", "0123456789abcdef"),
    "HEX": ("^[0-9A-F]+$", "0123456789ABCDEF"),
    "base32": ("^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    "base36": ("^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    "base62": ("^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    "base64": ("^[0-9A-Za-z+/]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    "base64url": ("^[0-9A-Za-z_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    "mixed": ("", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
}
#: Steps of the p-value scale for each power of ten, and the last step.
STEPS, LAST = 20, 400


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the leftmost matches that don't overlap, in code points."""
    gaps, values = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    pairs = F.zip_with(F.slice(gaps, 1, F.size(values)), values, lambda g, v: F.struct(F.length(g).alias("gap"), v.alias("value")))

    def add(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        end = start + F.length(p["value"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), p["value"].alias("value")))).alias("out"))

    found = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), add, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(none)


def upper_tail(z: Column) -> Column:
    """P(Z >= z) of a standard normal, by a rational fit of the complementary error function, good to 1e-7 of its value."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = 1 / (1 + 0.5 * x)
    # Fixed values of a published approximation.
    poly = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = poly * t + c
    tail = 0.5 * t * F.exp(poly - x * x)
    return F.when(z >= 0, tail).otherwise(1 - tail)


def battery(token: Column) -> Column:
    """struct<encoding, n, chi, runs, serial, p>: the tests' p-values and the combined one for a run."""
    encoding = F.lit("mixed")
    for name, (pattern, _) in reversed([x for x in ALPHABETS.items() if x[1][0]]):
        encoding = F.when(token.rlike(pattern), name).otherwise(encoding)
    alphabet = F.element_at(F.create_map(*[F.lit(x) for name, (_, a) in ALPHABETS.items() for x in (name, a)]), encoding)
    start = F.struct(encoding.alias("encoding"), alphabet.alias("alphabet"), F.split(F.rtrim(token, F.lit("=")), "").alias("chars"))
    # A let-binding: transform over an array of one, so that nothing is written out, or done, twice.
    let = lambda value, f: F.get(F.transform(F.array(value), f), 0)

    def numbers(s: Column) -> Column:
        v = F.transform(F.filter(s["chars"], lambda c: c != ""), lambda c: F.instr(s["alphabet"], c) - 1)
        return F.struct(s["encoding"].alias("encoding"), F.length(s["alphabet"]).cast("double").alias("k"), v.alias("v"))

    def sums(s: Column) -> Column:
        n, k = F.size(s["v"]).cast("double"), s["k"]
        squares = F.aggregate(F.array_distinct(s["v"]), F.lit(0.0), lambda acc, c: acc + F.pow(F.size(F.filter(s["v"], lambda x: x == c)).cast("double"), F.lit(2.0)))
        nexts = F.slice(s["v"], 2, F.size(s["v"]))
        both = F.zip_with(F.slice(s["v"], 1, F.size(s["v"]) - 1), nexts, lambda a, b: F.struct(((a >= k / 2) != (b >= k / 2)).cast("double").alias("turn"), ((a - (k - 1) / 2) * (b - (k - 1) / 2)).alias("product")))
        turns = F.aggregate(both, F.lit(0.0), lambda acc, b: acc + b["turn"])
        products = F.aggregate(both, F.lit(0.0), lambda acc, b: acc + b["product"])
        return F.struct(s["encoding"].alias("encoding"), n.alias("n"), k.alias("k"), (k / n * squares - n).alias("chi"), turns.alias("turns"), products.alias("products"))

    def values(s: Column) -> Column:
        n, df, m = s["n"], s["k"] - 1, s["n"] - 1
        cube = (F.pow(s["chi"] / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        runs = (s["turns"] - m / 2) / F.sqrt(m / 4)
        serial = s["products"] / (m * (s["k"] * s["k"] - 1) / 12) * F.sqrt(m)
        floor = lambda p: F.greatest(p, F.lit(1e-30))
        return F.struct(s["encoding"].alias("encoding"), n.cast("int").alias("n"), floor(upper_tail(cube)).alias("chi"), floor(2 * upper_tail(F.abs(runs))).alias("runs"), floor(2 * upper_tail(F.abs(serial))).alias("serial"))

    def combined(s: Column) -> Column:
        x = -(F.log(s["chi"]) + F.log(F.least(s["runs"], F.lit(1.0))) + F.log(F.least(s["serial"], F.lit(1.0))))
        p = F.exp(-x) * (1 + x + x * x / 2)
        return F.struct(s["encoding"], s["n"], s["chi"], s["runs"], s["serial"], p.alias("p"))

    return let(let(let(let(start, numbers), sums), values), combined)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", alpha: float = 0.05) -> DataFrame:
    """Secrets of every whole text: doc_id, base and random, arrays of struct<start, kind_order, end, kind>.

    ``base`` holds what the patterns find, ``random`` what the battery adds and no pattern
    meets; offsets are code points, ends are exclusive. A null text is empty; repeated rows
    are scanned each, but count in the rule as often as they stand there; an empty table gives
    no rows; other columns are not read.
    """
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def of(kind: str, found: Column) -> Column:
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind_order"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    assigned = F.filter(spans(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 6)
    base = F.array_sort(F.concat(of("assign", assigned), of("access", spans(text, ACCESS)), of("hex", spans(text, HEX))))
    mixed = F.filter(spans(text, RUN), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))
    rows = rows.select("doc_id", base.alias("base"), mixed.alias("runs"))
    rows = rows.withColumn("runs", F.filter("runs", lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"]))))
    tested = F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), battery(r["value"]).alias("t")))

    def stratum(s: Column) -> Column:
        step = F.least(F.floor(-F.log10(s["t"]["p"]) * STEPS), F.lit(LAST)).cast("int")
        name = F.concat_ws(":", s["t"]["encoding"], F.floor(F.log2(s["t"]["n"].cast("double"))).cast("string"))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), name.alias("stratum"), F.greatest(step, F.lit(0)).alias("step"))

    rows = cut(rows.select("doc_id", "base", F.transform(tested, stratum).alias("runs")))
    limits = set_aside(rows.select(F.explode("runs").alias("r")).select("r.stratum", "r.step"), alpha)
    first = F.create_map(*[F.lit(x) for kv in sorted(limits.items()) for x in kv]) if limits else F.create_map().cast("map<string,int>")
    random = F.filter("runs", lambda r: r["step"] < F.coalesce(F.try_element_at(first, r["stratum"]), F.lit(LAST + 1)))
    return rows.select("doc_id", "base", of("random", random).alias("random"))


def set_aside(rows: DataFrame, alpha: float) -> dict[str, int]:
    """stratum -> the first step whose p-values are small enough to be set aside as not random.

    Benjamini-Hochberg on counts by step: at the loosest step where the number of p-values
    there and below is at least ``m p / alpha``, with p the step's largest. There are at most
    as many rows as strata times steps, whatever the input.
    """
    counts = rows.groupBy("stratum", "step").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("stratum")
    below = F.sum("n").over(whole.orderBy(F.desc("step")))
    p = F.pow(F.lit(10.0), -F.col("step") / STEPS)
    passed = counts.withColumn("below", below).withColumn("m", F.sum("n").over(whole)).where(p * F.col("m") <= alpha * F.col("below"))
    return {r.stratum: r.step for r in passed.groupBy("stratum").agg(F.min("step").alias("step")).collect()}


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_random of :func:`scan`'s rows."""

    def said(array: Column) -> Column:
        return F.array_join(F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS[:3]]
    every = F.array_sort(F.concat("base", "random"))
    return found.select("doc_id", *counts, F.sha2(said(F.col("base")), 256).alias("base_sha256"), said(every).alias("spans"), F.size("random").cast("long").alias("n_random"))
