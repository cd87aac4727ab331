import hashlib
import random

import pytest
from pyspark.sql import functions as F

from plumbline.llm import linededup as ld

SCHEMA = "doc_id long, text string, lines string, id string"


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(r, text, n, letters="abcé "):
    for _ in range(n):
        at = r.randrange(len(text) + 1)
        text = r.choice([text[:at] + r.choice(letters) + text[at:], text[:at] + text[at + 1 :], text[:at] + r.choice(letters) + text[at + 1 :]])
    return text


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_automaton_and_keys(spark, edits):
    r = random.Random(edits)
    pairs = []
    for _ in range(400):
        a = "".join(r.choices("abcé ", k=r.randint(8, 30)))
        pairs.append((a, edited(r, a, r.randint(0, edits + 2))))
    df = spark.createDataFrame(pairs, "a string, b string")
    keys = lambda x, y: F.arrays_overlap(F.array(*ld.index_keys(x, edits)), F.array_compact(F.array(*ld.probe_keys(y, edits))))
    a, b = F.col("a"), F.col("b")
    longer, shorter = F.when(F.length("a") > F.length("b"), a).otherwise(b), F.when(F.length("a") > F.length("b"), b).otherwise(a)
    out = df.select("a", "b", ld.within(a, b, edits).alias("w"), keys(shorter, longer).alias("k"), ld.counts_apart(ld.letter_counts(a), ld.letter_counts(b)).alias("c")).collect()
    for row in out:
        near = edit_distance(row.a, row.b) <= edits
        assert row.w == near
        assert not near or (row.k and row.c <= 2 * edits)


@pytest.mark.parametrize("edits", [2, 5])
def test_both_ends_of_long_lines_are_read_first(spark, edits):
    """Errors at an end are the fewest there, and lines that are near pass both ends."""
    r = random.Random(edits)
    pairs = []
    for _ in range(150):
        a = "".join(r.choices("abcé ", k=r.randint(60, 130)))
        b = edited(r, a, r.randint(0, edits))
        pairs.append((a, r.choice([b, edited(r, b[:40], 3) + b[40:-40] + edited(r, b[-40:], 3), b[:9] + "x" + b[9:-9] + "y" + b[-9:]])))
    out = spark.createDataFrame(pairs, "a string, b string").select("a", "b", ld.within(F.col("a"), F.col("b"), edits).alias("w"), ld.least_errors(F.substring("a", 1, 20), F.substring("b", 1, 20 + edits), edits).alias("e")).collect()
    for row in out:
        assert row.w == (edit_distance(row.a, row.b) <= edits)
        assert row.e == min(edits + 1, *[edit_distance(row.a[:20], row.b[:n]) for n in range(20 - edits, 21 + edits)])
    assert 20 < sum(row.w for row in out) < 130


def brute(documents, edits, least):
    key = lambda raw: raw.strip(" \t\r").lower()
    docs = sorted({(d, t) for d, t in documents if t is not None})
    places = [(d, t, i, key(raw)) for d, t in docs for i, raw in enumerate(t.split("\n")) if len(key(raw)) >= least]
    first = {}
    for p in places:
        first.setdefault(p[3], p)
    order = list(first)
    near = {y for j, y in enumerate(order) for x in order[:j] if abs(len(x) - len(y)) <= edits and edit_distance(x, y) <= edits}
    out = []
    for d, t in documents:
        if t is None:
            out.append((d, 0, 0, 0, 0, None))
            continue
        raw, keep, repeated, n = t.split("\n"), [], 0, 0
        for i, x in enumerate(raw):
            k = key(x)
            if len(k) >= least and (first[k][0] != d or k in map(key, raw[:i])):
                repeated += 1
            elif len(k) >= least and k in near:
                n += 1
            else:
                keep.append(x)
        out.append((d, len(raw), repeated, n, len(keep), "\n".join(keep)))
    return sorted(out, key=str)


def corpus(seed=1):
    r, lines, documents = random.Random(seed), [], []
    for _ in range(60):
        lines.append("".join(r.choices("abcdé ", k=r.randint(5, 45))))
    lines += ["", "short", "A common line in many documents"]
    for i in range(80):
        text = [edited(r, r.choice(lines), r.choice([0, 0, 1, 2])) for _ in range(r.randint(0, 8))] + ["a Common line in many documents  "] * r.randint(0, 2)
        documents.append((i, "\n".join(text)))
    return documents + [(200, None), (201, ""), (202, "x" * 2_000 + "\n" + "x" * 1_999 + "y\n\n"), (3, documents[3][1])]


@pytest.mark.parametrize(("edits", "broadcast"), [(1, 10**6), (2, 0)])
def test_against_brute_force(spark, monkeypatch, edits, broadcast):
    monkeypatch.setattr(ld, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(ld, "BROADCAST_KEYS", broadcast)
    documents = corpus(edits)
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in documents], SCHEMA).repartition(3)
    out = ld.dedup_lines(df.withColumnRenamed("id", "_d"), edits=edits)
    assert out.columns == ["lines", "doc_id", "text", "_d"]
    got = sorted(((r.doc_id, r.lines.total, r.lines.repeated, r.lines.near, r.lines.kept, r.text) for r in out.collect()), key=str)
    want = brute(documents, edits, 20)
    assert got == want and sum(x[3] for x in want) > 5 and sum(x[2] for x in want) > 20


def test_edges(spark):
    df = spark.createDataFrame([(None, "the very same line of text", "x"), (1, "the very same line of text", "x"), (1, "the very same line of text", "x"), (1, "another text\nTHE VERY SAME line of text ", "x")], "doc_id long, text string, source string")
    got = sorted(((r.doc_id, r.source, r.text) for r in ld.dedup_lines(df).collect()), key=str)
    assert got == sorted([(None, "x", "the very same line of text"), (1, "x", ""), (1, "x", ""), (1, "x", "another text")], key=str)
    assert ld.dedup_lines(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        ld.dedup_lines(df, edits=0)


@pytest.mark.parametrize("edits", [4, 5])
def test_automaton_of_many_edits(spark, edits):
    r = random.Random(edits)
    pairs = [(a, edited(r, a, r.randint(0, edits + 3))) for a in ("".join(r.choices("abcé ", k=r.randint(8, 40))) for _ in range(300))]
    out = spark.createDataFrame(pairs, "a string, b string").select("a", "b", ld.within(F.col("a"), F.col("b"), edits).alias("w")).collect()
    assert all(x.w == (edit_distance(x.a, x.b) <= edits) for x in out) and 30 < sum(x.w for x in out) < 290


def test_edits_by_length(spark):
    steps = ((20, 1), (40, 2), (60, 3), (80, 4), (100, 5))
    r, documents = random.Random(3), []
    for i in range(60):
        line = "".join(r.choices("abcdefghij ", k=r.choice([25, 38, 40, 42, 59, 61, 79, 82, 98, 100, 103, 150]))).strip()
        documents += [(3 * i + k, edited(r, line, n) + "\n" + edited(r, line, n + 1)) for k, n in enumerate(r.sample(range(6), 3))]
    out = ld.dedup_lines(spark.createDataFrame(documents, "doc_id long, text string").repartition(3), edits=steps)
    places = [(d, i, raw.strip().lower()) for d, t in documents for i, raw in enumerate(t.split("\n"))]
    allowed = lambda n: max(e for least, e in steps if n >= least)
    gone, near = {}, 0
    for at, (d, i, k) in enumerate(places):
        before = [x for _, _, x in places[:at]]
        close = any(abs(len(x) - len(k)) <= 5 and edit_distance(x, k) <= allowed(min(len(x), len(k))) for x in before if x != k)
        near += k not in before and close
        if k in before or close:
            gone.setdefault(d, set()).add(i)
    want = sorted((d, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, ()))) for d, t in documents)
    assert sorted((x.doc_id, x.text) for x in out.collect()) == want and near > 60


def test_the_registered_query_finds_five_edits_in_a_long_line(spark, tmp_path):
    from plumbline.llm import registry

    line = "".join(random.Random(9).choices("abcdefghijkl ", k=120))
    other = line[:10] + "ZZ" + line[12:50] + line[51:90] + "Y" + line[90:110] + "X" + line[111:]
    df = spark.createDataFrame([(1, line, 120), (2, other, 120), (3, "W" + other, 121)], "doc_id long, text string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert {x.doc_id for x in registry.op5_line_dedup(spark, str(tmp_path)).collect() if not x.text} == {2, 3}


def test_templated_lines_do_not_meet_as_all_pairs(spark, monkeypatch):
    """Many lines with one common first half, or start and end; a few are near to one another."""
    r, rows = random.Random(4), []
    start, end = "This is the very common start of a line, and then ", " and this is its common end, which all have."
    for i in range(500):
        own = "".join(r.choices("0123456789", k=50))
        rows.append(start + own + (end if i % 2 else ""))
    rows += [edited(r, x, 4) for x in rows[:20]]
    documents = [(i, x) for i, x in enumerate(rows)]
    monkeypatch.setattr(ld, "HOT", 32)
    seen, alike = [], ld._alike
    monkeypatch.setattr(ld, "_alike", lambda steps: seen.append(1) or alike(steps))
    out = ld.dedup_lines(spark.createDataFrame(documents, "doc_id long, text string").repartition(4), edits=ld.EDITS)
    gone = {x.doc_id for x in out.collect() if not x.text}
    assert gone == set(range(500, 520)) and len(seen) > 2


def test_dense_and_short_and_long_lines(spark):
    lines = [f"an entry of a long list that is number {i:03d} of its kind" for i in range(120)]
    documents = [(i, x + "\nok\n\n" + "}" * (i % 3)) for i, x in enumerate(lines)]
    long = " ".join(str(random.Random(5).random()) for _ in range(5)) + "é" * 1_100_000
    documents += [(900, long), (901, long[:500_000] + "x" + long[500_000:])]
    out = {x.doc_id: x for x in ld.dedup_lines(spark.createDataFrame(documents, "doc_id long, text string"), edits=ld.EDITS, exact_least=1).collect()}
    # two edits lead from each number to one before it
    assert out[0].text == documents[0][1] and all(out[i].lines.near == 1 for i in range(1, 120))
    # short lines go as equal ones alone, blank lines stay
    assert out[1].text == "\n}" and out[2].text == "\n}}" and out[4].text == "" and out[3].lines.total == 4
    assert out[900].text == long and out[901].text == ""


def test_line_with_more_lines_than_a_filter_by_place_could_take(spark):
    text = "\n".join(hashlib.md5(str(i % 20_000).encode()).hexdigest() for i in range(40_000))
    out = ld.dedup_lines(spark.createDataFrame([(1, text)], "doc_id long, text string"), edits=1).collect()[0]
    assert out.lines.total == 40_000 and out.lines.repeated == 20_000 and out.lines.kept == 20_000 - out.lines.near


def test_counts_are_compared_as_whole_longs(spark):
    """A difference of counts is the way around the circle of 16, of whatever letters, and no pair's condition has a count of its own."""
    rows = spark.createDataFrame([("e" * i + "9" * (j % 3), "e" * j + "h") for i in range(20) for j in range(20)], "a string, b string")
    apart = ld.counts_apart(ld.letter_counts(F.col("a")), ld.letter_counts(F.col("b")))
    for r in rows.select("a", "b", apart.alias("n")).collect():
        d = abs(r.a.count("e") - r.b.count("e")) % 16
        assert r.n == min(d, 16 - d) + r.a.count("9") + 1
    counts = rows.select(ld.letter_counts(F.col("a")).alias("x"), ld.letter_counts(F.col("b")).alias("y"))
    assert str(ld.counts_apart(F.col("x"), F.col("y"))).count("bit_count") == 3 and counts.schema["x"].dataType.typeName() == "struct"


def test_a_step_of_the_automaton_grows_with_the_band_alone(spark):
    """The expression of a step had the square of the edits; now it has what one more diagonal on each side takes."""
    size = lambda edits: len(ld.within(F.col("a"), F.col("b"), edits)._jc.toString())
    assert size(5) - size(3) < 1.2 * (size(3) - size(1))


def test_lines_are_broadcast_to_their_pairs_or_joined(spark, monkeypatch):
    r, rows = random.Random(8), []
    for i in range(60):
        a = "".join(r.choices("abcdefgh ", k=120))
        rows += [(4 * i + k, i, f"{i:04d}", x) for k, x in enumerate([a, edited(r, a, 4), a[:40] + "other words " + a[50:], edited(r, a, 9)])]
    texts = spark.createDataFrame([(h, g, first, line) for h, g, first, line in rows], "h long, g long, first string, line string")
    pairs = spark.createDataFrame([(4 * i + j, 4 * i + k) for i in range(60) for j in range(4) for k in range(j)], "h_a long, h_b long")
    line = {h: x for h, _, _, x in rows}
    want = {max(a, b) if (a // 4) == (b // 4) else None for a, b in [tuple(p) for p in pairs.collect()] if edit_distance(line[a], line[b]) <= 5}
    texts = texts.withColumn("first", F.struct("first", "h"))
    for most in (ld.BROADCAST_BYTES, 0):
        monkeypatch.setattr(ld, "BROADCAST_BYTES", most)
        out = ld._verified(pairs, texts, [(20, 5)], ld.Tables(spark))
        assert {x.h for x in out.collect()} == want and len(want) >= 60
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" in plan and "SortMergeJoin" not in plan) or not most


@pytest.mark.parametrize("edits", [2, 5])
def test_a_segment_has_one_substring_for_each_place(spark, edits):
    """Both lines look for each other, so a segment numbered i has i + 1 substrings (2i + 1 were probed and one indexed before)."""
    assert len(ld._codes(edits)) == sum(i + 1 for _, i in ld.halves(edits)) < sum(2 * i + 1 for _, i in ld.halves(edits))
    lines = spark.createDataFrame([(1, "".join(random.Random(edits).choices("abcdefgh ", k=125)))], "h long, line string")
    keys = ld.line_keys(lines, [(20, edits)]).collect()
    assert len(keys) == len(ld._codes(edits)) and all(k.own for k in keys)


def test_parts_tell_pairs_before_they_are_rows(spark):
    """Near lines pass by parts and by a key of theirs; lines with a word changed in each half don't."""
    r, rows = random.Random(6), []
    for _ in range(120):
        a = "".join(r.choices("ehtaonisrl ", k=125))
        rows += [(a, edited(r, a, r.randint(1, 5), "ehta"), 1), (a[:20] + "wwwwwwww" + a[28:], a[:90] + "gggggggg" + a[98:], 0)]
    df = spark.createDataFrame(rows, "a string, b string, near int").withColumn("e", F.lit(5)).withColumn("wide", F.lit(18))
    df = df.select("a", "b", "near", "e", *[ld.part_counts(F.col(c), F.col("e"), F.col("wide")).alias(f"p{c}") for c in "ab"])
    codes = F.array(*[F.lit(c) for c in ld._codes(5) if (c & 15) == 8])
    here = F.exists(codes, lambda c: ld.found_here(F.col("pa"), F.col("pb"), F.col("e"), c))
    for x in df.select("near", ld.parts_alike(F.col("pa"), F.col("pb"), F.col("e")).alias("alike"), here.alias("here")).collect():
        assert x.alike == bool(x.near) and (x.here or not x.near)
