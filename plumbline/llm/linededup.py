"""Operator 5: line deduplication by a segment-partition edit join.

A line is cut into ``edits + 1`` segments of one width, half of them measured from its start and
half from its end. Of two lines within ``edits`` edits, either the segments at the start hold fewer
edits than there are of them or those at the end do. So a segment is whole in both lines, the i-th of
its half with at most i edits outside it, and stands at most i characters from its place. Of it the
substrings i characters narrower are hashed that begin 0 to i characters into it: wherever the segment
stands in the other line, one of these begins in one line at its place and is one of the other's. So
lines look for each other with i + 1 substrings of a segment, not 2i + 1. Widths go by classes of
lengths, so that few substrings do for all lengths, and a line just over a class's bound has those of
the class below, too.

The first pass shuffles hashes alone and finds the live substrings, those that several lines share.
Only lines that have one are read again. The earliest line of a live substring is compared with all
others, and lines that are near to it are settled: what they are near to is of no further interest.
Then unsettled lines meet all earlier lines, by index and probe. A substring that many lines share, as
templates have, is not joined but goes on: what a pair has beside the segment, allowed the edits
that are left, is cut into segments in turn, until few lines share a key. Counts of frequent
characters travel along, and pairs whose counts differ by more than the edits allow are dropped
where they meet, for the whole and for what is before and after a few places, as errors before a place
and after it add up. What is left is verified by a bit-parallel automaton along the band of diagonals.

Equal lines are one line from the start, found by hash aggregation with partial sums, so a
line that stands in a third of all documents is one row for each task. All of it is DataFrame
operations, and a line or text of any length is one row.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.llm.common import Tables

#: (least length, edits) of a corpus: about one edit for 20 characters, and never more than five.
EDITS = ((20, 1), (40, 2), (60, 3), (80, 4), (100, 5))

#: Characters whose counts are compared, each modulo 16; eight to a long.
LETTERS = "ehtaonisrlduc0123456789 "
#: The same for parts of lines.
PART_LETTERS = "ehtaonisrlduwg05"
#: Most rows of hashes that are broadcast to pick up what belongs to them; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: The same for keys alone, of eight bytes each.
BROADCAST_KEYS = 2_000_000
#: Most bytes of lines that are broadcast to the pairs that need them, and pairs that a task verifies then; beyond, lines are joined by shuffles.
BROADCAST_BYTES, PAIRS = 24_000_000, 2_000
#: Most rows that share a substring and are joined as they are; beyond, the rest of their lines is cut further, this often at most.
HOT, ROUNDS = 4096, 16
#: Least rows that share a substring for their parts to be counted.
MANY = 16


def halves(edits: int) -> list[tuple[int, int]]:
    """(side, number) of the segments: of ``edits + 1``, half from the start (0), fewer from the end (1)."""
    return [(0, i) for i in range((edits + 2) // 2)] + [(1, i) for i in range((edits + 1) // 2)]


def width(n: Column, edits: Column) -> Column:
    """Width of the segments of a text of ``n`` characters, by its class: lengths with the same three leading bits."""
    bits = F.greatest(F.lit(0), F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double"))).cast("int") - 2)
    least = F.call_function("shiftleft", F.call_function("shiftright", n, bits), bits)
    return F.floor(least / (edits + 1)).cast("int")


def _codes(edits: int) -> list[int]:
    """Side, number and shift (8 for none) of the substrings to look at, each in one number."""
    return [side * 256 + i * 16 + shift + 8 for side, i in halves(edits) for shift in range(i + 1)] if edits else [-1]


def _number(code: Column) -> Column:
    """Number of a code's segment in its half, which is also by how much its substrings are narrower."""
    return F.shiftright(code, 4).bitwiseAND(15)


def _unshifted(code: Column) -> Column:
    """Whether a substring begins where its segment does; of two that are one segment, one does."""
    return (code < 0) | (code.bitwiseAND(15) == 8)


def _start(code: Column, n: Column, wide: Column) -> Column:
    """Where a text of ``n`` characters has the substring of a code."""
    i, shift = _number(code), code.bitwiseAND(15) - 8
    return F.when(code < 256, i * wide).otherwise(n - (i + 1) * wide) + shift


def wide_text(text: Column) -> Column:
    """A text in four bytes for each character, so that a substring is where it is without counting."""
    return F.encode(text, "UTF-32")


def _table() -> Column:
    """By edits, what to look at: a code, the factors of the text's length and the width whose sum, with a shift, is its place in bytes, and how many it is narrower."""

    def row(edits: int, code: int) -> Column:
        i, shift, right = (code >> 4) & 15, (code & 15) - 8, code >= 256
        place = (int(right), -(i + 1) if right else i, 4 * shift + 1, 4 * i) if code >= 0 else (0, 0, 0, 0)
        return F.struct(F.lit(code).alias("code"), F.lit(edits * 512 + (code >> 4)).alias("seed"), *[F.lit(x).alias(c) for c, x in zip("rmsi", place, strict=True)])

    return F.array(*[F.array(*[row(e, c) for c in _codes(e)]) for e in range(6)])


def segment_key(x: Column, data: Column, n: Column, edits: Column, wide: Column, under: Column) -> Column:
    """The hash of the substring of a segment that a row ``x`` of the table means.

    ``data`` is the :func:`wide_text`. Texts too short for segments all have the one key of such, and those that
    allow no edits are one segment. A substring that would not be inside gives a key of no meaning, which
    costs a comparison at most.
    """
    part = F.substring(data, x["r"] * 4 * n + x["m"] * 4 * wide + x["s"], 4 * wide - x["i"])
    alone = F.when(edits == 0, F.xxhash64(under, F.lit(-2), data)).otherwise(F.xxhash64(under, -3 - edits))
    return F.when(x["code"] < 0, alone).otherwise(F.xxhash64(under, x["seed"], part))


def _rows(edits: Column, wide: Column) -> Column:
    """The table's rows for a text; it is too short if the narrowest substrings would be empty."""
    table = _table()
    return F.when(wide <= F.shiftright(edits, 1), F.get(table, F.lit(0))).otherwise(F.get(table, edits))


def _keys(line: Column, edits: int, d: int) -> list[Column]:
    n, e = F.length(line), F.lit(edits)
    wide, data = width(n - d, e), wide_text(line)
    found = F.transform(_rows(e, wide), lambda x: segment_key(x, data, n, e, wide, F.lit(0).cast("long")))
    return [F.get(found, i) for i in range(len(_codes(edits)))]


def index_keys(line: Column, edits: int) -> list[Column]:
    """Hashes of the substrings of a line's segments."""
    return _keys(line, edits, 0)


def probe_keys(line: Column, edits: int) -> list[Column]:
    """Hashes of the same for lines as long or up to ``edits`` shorter."""
    return [key for d in range(edits + 1) for key in _keys(line, edits, d)]


#: Counts modulo 16 in eight bits, of which as many differ between two as the counts are apart around the circle.
CIRCLE = [(1 << c) - 1 if c <= 8 else 256 - (1 << (c - 8)) for c in range(16)]


def letter_counts(line: Column, letters: str = LETTERS) -> Column:
    """Counts of eight bits each, eight to each long of a struct, so that pairs are compared by whole longs."""
    longs = []
    for at in range(0, len(letters), 8):
        total = F.lit(0).cast("long")
        for j, letter in enumerate(letters[at : at + 8]):
            count = (F.length(line) - F.length(F.replace(line, F.lit(letter), F.lit("")))).bitwiseAND(15)
            total = total.bitwiseOR(F.shiftleft(F.get(F.array(*[F.lit(c).cast("long") for c in CIRCLE]), count), 8 * j))
        longs.append(total.alias(f"c{at // 8}"))
    return F.struct(*longs)


def counts_apart(a: Column, b: Column, letters: str = LETTERS) -> Column:
    """Least sum of differences between counts that two structs stand for; an edit changes it by two at most."""
    return functools.reduce(Column.__add__, [F.bit_count(a[f"c{i}"].bitwiseXOR(b[f"c{i}"])) for i in range(-(-len(letters) // 8))])


def part_counts(line: Column, edits: Column, wide: Column) -> Column:
    """Counts before (a0 to a2) and after (z0 to z2) three places of a line, the second between its halves, and hashes of its first and last segment."""
    middle, found = F.floor((edits + 2) / 2), []
    for k in range(3):
        at = (F.greatest(F.lit(1), F.least(edits, middle + k - 1)) * wide).cast("int")
        after = ((edits + 1) * wide - at).cast("int")
        found.append(letter_counts(F.substring(line, F.lit(1), at), PART_LETTERS).alias(f"a{k}"))
        found.append(letter_counts(F.substring(line, F.length(line) - after + 1, after), PART_LETTERS).alias(f"z{k}"))
    ends = F.substring(line, F.lit(1), wide), F.substring(line, F.length(line) - wide + 1, wide)
    return F.struct(*found, *[F.xxhash64(x).alias(c) for c, x in zip(("first", "last"), ends, strict=True)])


def parts_alike(a: Column, b: Column, edits: Column) -> Column:
    """Whether :func:`part_counts` leave open that two lines of one class are near.

    Edits before a place change the counts before it by two at most each, also where the other line's part of as many
    characters is not the aligned one, and those after it the counts after it; so both sides' least edits add up.
    """
    least = lambda c: F.shiftright(counts_apart(a[c], b[c], PART_LETTERS) + 1, 1)
    return functools.reduce(Column.__and__, [least(f"a{k}") + least(f"z{k}") <= edits for k in (1, 0, 2)])


def found_here(a: Column, b: Column, edits: Column, code: Column) -> Column:
    """Whether a pair of one class is to be found by this key of whole lines.

    The half of the key has fewer edits than segments. Where both begin (or end) with the same segment, an alignment has it
    whole, so that half's other segments need not find the pair; and the right half need not if the first segment does.
    """
    few = lambda c, segments: counts_apart(a[c], b[c], PART_LETTERS) <= 2 * (segments - 1)
    left, right = few("a1", F.shiftright(edits + 2, 1)), few("z1", F.shiftright(edits + 1, 1))
    first, last = a["first"] == b["first"], a["last"] == b["last"]
    begins = _number(code) == 0
    return F.when(code < 0, True).when(code < 256, left & (begins | ~first)).otherwise(right & ~(first & left) & (begins | ~last))


def _shared(a: Column, b: Column) -> Column:
    """How many characters two texts begin with alike, by halving; both texts are made once, whatever they come from."""

    def halved(p: Column) -> Column:
        same = lambda at, n: F.substring(p["a"], at + 1, n) == F.substring(p["b"], at + 1, n)
        return F.aggregate(F.array(*[F.lit(1 << k) for k in range(30, -1, -1)]), F.lit(0), lambda at, n: F.when((n <= p["most"] - at) & same(at, n), at + n).otherwise(at))

    most = lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), F.least(F.length(p["a"]), F.length(p["b"])).alias("most"))
    return T.let(F.struct(a.alias("a"), b.alias("b")), lambda p: T.let(most(p), halved))


def _errors(state: Column) -> Column:
    """The errors that a state has counted on its diagonal."""
    return F.shiftright(state, 22).bitwiseAND(4095)


def _state(a: Column, b: Column, edits: int, diagonal: Column, most: Column) -> Column:
    """The automaton's state when it has read all of ``a`` against ``b``, or when the ``diagonal`` has come to ``most`` errors.

    Bits stand for the ``2 * edits + 1`` diagonals of the band, from the lowest; more are out of reach. A column of
    distances is two sets of bits, where it rises and where it falls from one character of ``b`` to the next, and a
    character of ``a`` moves all of it at once (Hyyro's banded form of Myers' algorithm), whatever the number of edits.
    A long has the rises in its first 11 bits, the falls in the next, from bit 22 the errors on the ``diagonal``, which never
    become fewer, and from bit 34 the number of characters read.
    """
    width = 2 * edits + 1
    long = lambda x: F.lit(x).cast("long")
    band, chars = long((1 << width) - 1), lambda text: F.filter(F.split(text, ""), lambda c: c != "")

    def read(p: Column) -> Column:
        def step(s: Column, c: Column) -> Column:
            rises, falls = s.bitwiseAND(band), F.shiftright(s, 11).bitwiseAND(band)

            def equal(at: Column) -> Column:
                bits = [F.when(F.get(p["b"], at + (o - edits)) == c, long(1 << o)).otherwise(long(0)) for o in range(width)]
                return functools.reduce(Column.bitwiseOR, bits)

            def moved(free: Column) -> Column:
                # Bits of ``free`` are the diagonals on which this character costs nothing.
                up = falls.bitwiseOR(F.bitwise_not(free.bitwiseOR(rises))).bitwiseAND(band)
                below = F.shiftright(free, 1)
                now = free.bitwiseAND(rises).bitwiseOR(F.bitwise_not(below.bitwiseOR(up)).bitwiseAND(band))
                costs = (F.shiftright(s, 34) + p["d"] >= edits) & (free.bitwiseAND(p["bit"]) == 0)
                read_so_far = F.shiftleft(F.shiftright(s, 22), 22) + F.when(costs, long((1 << 34) + (1 << 22))).otherwise(long(1 << 34))
                return read_so_far + now + F.shiftleft(below.bitwiseAND(up), 11)

            free = lambda x: (x.bitwiseAND(rises) + rises).bitwiseXOR(rises).bitwiseOR(x).bitwiseOR(falls).bitwiseAND(band)
            go_on = T.let(equal(F.shiftright(s, 34).cast("int")), lambda x: T.let(free(x), moved))
            return F.when(_errors(s) >= p["most"], s).otherwise(go_on)

        start = long(((1 << (edits + 1)) - 1) << edits) + F.shiftleft(F.abs(p["d"] - edits).cast("long"), 22)
        return F.aggregate(p["a"], start, step)

    bit = F.element_at(F.array(*[long(1 << o) for o in range(width)]), diagonal + 1)
    return T.let(F.struct(chars(a).alias("a"), chars(b).alias("b"), diagonal.alias("d"), bit.alias("bit"), most.alias("most")), read)


#: Characters at each end of a longer text that are read first; it is given up if they take more edits than are allowed.
FIRST = 32


def least_errors(a: Column, b: Column, edits: int) -> Column:
    """Fewest errors, at most ``edits`` + 1, with which all of ``a`` meets any start of ``b``: the least of the last column."""

    def least(s: Column) -> Column:
        mid, found = _errors(s), [F.lit(edits + 1).cast("long")]
        count = lambda bits: F.bit_count(s.bitwiseAND(bits)) - F.bit_count(F.shiftright(s, 11).bitwiseAND(bits))
        # After a step the bits stand one diagonal higher, so a difference to the diagonal above is in that bit less one.
        for o in range(2 * edits + 1):
            low, high = min(o, edits), max(o, edits)
            between = F.lit(((1 << high) - 1) ^ ((1 << low) - 1)).cast("long")
            found.append(mid + count(between) if o > edits else mid - count(between) if o < edits else mid)
        return F.least(*found).cast("int")

    return T.let(_state(a, b, edits, F.lit(edits), F.lit(4095)), least)


def within(a: Column, b: Column, edits: int, allowed: Column | None = None) -> Column:
    """Whether ``b`` is at most ``edits`` edits (or ``allowed``, which are no more) from ``a``, by a bit-parallel automaton along the band of diagonals.

    What both begin or end with alike changes no distance and is left off; of what is left of a long text
    ``FIRST`` characters from its start and from its end are read before the whole is: they don't overlap, so their
    errors add up, and lines that differ in two places are mostly told by them. ``edits`` is at most 5.
    """
    allowed = F.lit(edits) if allowed is None else allowed

    def judged(m: Column) -> Column:
        x, y, allowed = m["x"], m["y"], m["allowed"]
        longer = F.length(y) - F.length(x)
        near = _errors(_state(x, y, edits, longer + edits, allowed + 1)) <= allowed
        errors = lambda p, q: least_errors(F.substring(p, 1, FIRST), F.substring(q, 1, FIRST + edits), edits)
        dead = T.let(errors(x, y), lambda e: F.when(e > allowed, True).otherwise(e + errors(F.reverse(x), F.reverse(y)) > allowed))
        hopeless = F.when((F.length(x) > 2 * FIRST) & (F.length(y) > 2 * FIRST), dead).otherwise(False)
        return F.when(F.abs(longer) > allowed, False).when(F.greatest(F.length(x), F.length(y)) <= allowed, True).when(hopeless, False).otherwise(near)

    def ends(m: Column) -> Column:
        cut = lambda n: F.struct(F.substring(m["x"], F.lit(1), F.length(m["x"]) - n).alias("x"), F.substring(m["y"], F.lit(1), F.length(m["y"]) - n).alias("y"), m["allowed"].alias("allowed"))
        return T.let(_shared(F.reverse(m["x"]), F.reverse(m["y"])), lambda n: T.let(cut(n), judged))

    begins = lambda n: F.struct(F.substring(a, n + 1, F.length(a)).alias("x"), F.substring(b, n + 1, F.length(b)).alias("y"), allowed.alias("allowed"))
    return T.let(_shared(a, b), lambda n: T.let(begins(n), ends))


def _lines(base: DataFrame, least: int) -> DataFrame:
    """(d, t, pos, line, h, g): all lines of at least ``least`` characters, trimmed and in lower case; h and g are 128 bits of hashes."""
    rows = base.select("d", "t", F.posexplode(F.split(F.lower("text"), "\n", -1)).alias("pos", "line"))
    rows = rows.withColumn("line", F.trim("line", F.lit(" \t\r"))).where(F.length("line") >= least)
    return rows.withColumn("h", F.xxhash64("line")).withColumn("g", F.xxhash64(F.lit("g"), "line"))


def steps_of(edits: int | Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """(least length, edits) in rising order, the first for all shorter lines too."""
    steps = [(0, edits)] if isinstance(edits, int) else sorted(edits)
    allowed = [e for _, e in steps]
    if not steps or allowed != sorted(allowed) or not all(1 <= e <= 5 for e in allowed):
        raise ValueError("edits is from 1 to 5, and longer lines are allowed no fewer")
    return steps


def allowed_edits(n: Column, steps: list[tuple[int, int]]) -> Column:
    """Edits that a line of ``n`` characters allows; a pair's are those of the shorter."""
    allowed = F.lit(steps[0][1])
    for least, edits in steps[1:]:
        allowed = F.when(n >= least, edits).otherwise(allowed)
    return allowed


def _few(df: DataFrame, most: int | None = None) -> DataFrame:
    """``df``, broadcast if it has few enough rows, which are counted."""
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if most is None else most) else df


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` (data, n, e, wide, own, under, ...) by entry: key and code in place of data.

    The table is exploded, not the keys, so that keys are made in compiled code.
    """
    key = segment_key(F.col("x"), F.col("data"), F.col("n"), F.col("e"), F.col("wide"), F.col("under"))
    rest = [c for c in rows.columns if c not in ("data", "own", "under")]
    return rows.withColumn("x", F.explode(_rows(F.col("e"), F.col("wide")))).select(*rest, key.alias("key"), "x.code", "own")


def _class(n: Column, edits) -> Column:
    """The edits and the width of a text of ``n`` characters in one long."""
    return edits(n).cast("long") * 2**40 + width(n, edits(n))


def _one_class(n: Column, edits, most: int) -> Column:
    """Whether texts up to ``most`` characters shorter are of this one's class, as of nearly all; classes rise with the length."""
    return _class(n - most, edits) == _class(n, edits)


def _classes(n: Column, edits, shorter: Sequence[int]) -> Column:
    """Distinct classes, to be read by :func:`_of_class`, of texts that are ``shorter`` by these many characters and still may be near; this text's is the first."""
    kinds = [F.when((n - d >= 0) & (edits(n - d) >= abs(d)), _class(n - d, edits)).otherwise(_class(n, edits)) for d in sorted(shorter, key=abs)]
    return F.array_distinct(F.array(*kinds))


def _of_class(rows: DataFrame, classes: Column) -> DataFrame:
    """``rows`` by class, with e, wide and whether it is the own one, the first."""
    rows = rows.withColumn("x", classes).withColumn("kind", F.explode("x"))
    rows = rows.withColumn("own", F.col("kind") == F.get("x", F.lit(0))).withColumn("e", F.shiftright("kind", 40).cast("int"))
    return rows.withColumn("wide", F.col("kind").bitwiseAND(2**40 - 1).cast("int")).drop("x", "kind")


def line_keys(lines: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
    """Entries of whole lines (h, line): h, key, code, e, wide, n, own."""
    allowed, most = lambda n: allowed_edits(n, steps), steps[-1][1]
    rows = lines.select("h", "line", F.length("line").alias("n"))
    own = rows.withColumn("own", F.lit(True)).withColumn("e", allowed(F.col("n"))).withColumn("wide", width(F.col("n"), F.col("e")))
    # Few lines are of several classes; each begins where a text shorter by one more is of another. All of it is compiled code.
    shorter = F.col("n") - F.col("d")
    several = rows.where(~_one_class(F.col("n"), allowed, most)).withColumn("d", F.explode(F.array(*[F.lit(d) for d in range(1, most + 1)])))
    others = several.where((shorter >= 0) & (allowed(shorter) >= F.col("d")) & (_class(shorter, allowed) != _class(shorter + 1, allowed)))
    others = others.select("h", "line", "n", F.lit(False).alias("own"), allowed(shorter).alias("e"), width(shorter, allowed(shorter)).alias("wide"))
    ready = ["h", wide_text(F.col("line")).alias("data"), "n", F.lit(0).cast("long").alias("under"), "e", "wide", "own"]
    return _keyed(own.select(*ready)).union(_keyed(others.select(*ready)))


def _deeper(hot: DataFrame, texts: DataFrame, tables: Tables) -> DataFrame:
    """Entries of what rows (key, code, h, e, wide, at, n, own) have beside the substring that they share, below its key.

    A segment's number is the number of edits outside its half's end, so those on the other side are fewer by it.
    """
    start, i = _start(F.col("code"), F.col("n"), F.col("wide")), _number(F.col("code"))
    end = start + F.col("wide") - i
    left = F.col("code") < 256
    at = F.when(left, F.col("at") + end).otherwise(F.col("at"))
    n = F.when(left, F.col("n") - end).otherwise(start)
    rest = hot.select("h", F.col("key").alias("under"), at.alias("at"), n.alias("n"), (F.col("e") - i).alias("e"), F.col("own").alias("index")).distinct()
    rest = rest.join(texts.select("h", "line"), "h").withColumn("data", wide_text(F.substring(F.col("line"), F.col("at") + 1, F.col("n")))).drop("line")
    by_edits = F.array(*[_classes(F.col("n"), lambda _, e=e: F.lit(e), range(-e, e + 1)) for e in range(6)])
    rows = _of_class(rest, F.get(by_edits, F.col("e")))
    return tables.put(_keyed(rows.withColumn("own", F.col("own") & F.col("index")).drop("index")))


def _alike(steps: list[tuple[int, int]]) -> Column:
    """Whether lengths and counts of lines a and b leave open that they are near, and neither is the other."""
    allowed = allowed_edits(F.least("size_a", "size_b"), steps)
    apart = counts_apart(F.col("counts_a"), F.col("counts_b"))
    return (F.col("h_a") != F.col("h_b")) & (F.abs(F.col("size_a") - F.col("size_b")) <= allowed) & (apart <= 2 * allowed)


def _side(rows: DataFrame, name: str, *others: str) -> DataFrame:
    return rows.select(*others, *[F.col(c).alias(f"{c}_{name}") for c in rows.columns if c not in others])


def _verified(pairs: DataFrame, texts: DataFrame, steps: list[tuple[int, int]], tables: Tables) -> DataFrame:
    """(h, g) of the later lines of the pairs (h_a, h_b), a table of hashes, that are within the shorter's edits."""
    met = tables.put(pairs.select(F.col("h_a").alias("h")).union(pairs.select("h_b")).distinct())
    lines = tables.put(texts.join(_few(met), "h").select("h", "g", "first", "line"))
    held = lines.agg(F.sum(F.octet_length("line"))).first()[0] or 0
    if held <= BROADCAST_BYTES:
        # Pairs are two hashes each where they are dealt out, and no line is written for each of its pairs.
        pairs, lines = pairs.repartition(1 + pairs.count() // PAIRS, "h_a", "h_b"), F.broadcast(lines)
    met = pairs.join(_side(lines, "a"), "h_a").join(_side(lines, "b"), "h_b")
    allowed = allowed_edits(F.least(F.length("line_a"), F.length("line_b")), steps)
    close = within(F.col("line_a"), F.col("line_b"), steps[-1][1], allowed)
    later = F.when(F.col("first_a") > F.col("first_b"), F.struct(F.col("h_a").alias("h"), F.col("g_a").alias("g"))).otherwise(F.struct(F.col("h_b").alias("h"), F.col("g_b").alias("g")))
    return met.where(close).select(later.alias("l")).select("l.*").distinct()


def near_lines(first: DataFrame, steps: list[tuple[int, int]], tables: Tables) -> DataFrame:
    """(h, g) of lines that are within the shorter's edits of one whose first place is before theirs."""
    by_key = line_keys(first.select("h", "line"), steps).groupBy("key").agg(F.min("h").alias("least"), F.max("h").alias("most"))
    live = tables.put(by_key.where("least <> most").select("key"))
    holders = first.select("h", "line")
    if live.count() > BROADCAST_KEYS:
        # What is shuffled to meet the live keys is hashes; lines that have one are few, and their entries are made again.
        hashes = line_keys(holders, steps).select("key", "h").join(live, "key", "left_semi").select("h").distinct()
        holders = holders.join(_few(tables.put(hashes)), "h")
    found = line_keys(holders, steps).join(_few(live, BROADCAST_KEYS), "key").distinct()
    found = tables.put(found.withColumn("at", F.lit(0)))
    known = tables.put(found.select("h").distinct())
    texts = first.join(_few(known), "h").groupBy("h", "g").agg(F.min(F.struct("d", "t", "pos")).alias("first"), F.first("line").alias("line"))
    texts = tables.put(texts.select("h", "g", "first", "line", letter_counts(F.col("line")).alias("counts")))
    marks = texts.select("h", "first", F.length("line").alias("size"), "counts")
    lines = tables.put(found.select("key", "h").distinct().join(_few(marks), "h"))
    earliest = F.min(F.struct("first", "h", "size", "counts")).alias("p")
    pivots = tables.put(lines.groupBy("key").agg(earliest, F.count(F.lit(1)).alias("lines")))
    pairs = _side(lines, "b", "key").join(_side(pivots.select("key", "p.*"), "a", "key"), "key")
    pairs = tables.put(pairs.where(_alike(steps)).select("h_a", "h_b").distinct())
    settled = tables.put(_verified(pairs, texts, steps, tables))
    # What is left: substrings of three lines and more, of which one that is not the earliest is unsettled.
    marks = texts.select("h", "g", "first", F.length("line").alias("size"), "counts").join(_few(settled.withColumn("settled", F.lit(True))), ["h", "g"], "left")
    marks = tables.put(marks.select("h", "first", "size", "counts", F.col("settled").isNull().alias("open")))
    state = found.join(_few(pivots.where("lines > 2").select("key", F.col("p.h").alias("p"))), "key").join(_few(marks.select("h", "open")), "h")
    state = tables.put(state)
    unsettled = state.where("open and h <> p").select("key").distinct()
    state = tables.put(state.drop("p", "open").join(_few(tables.put(unsettled)), "key"))
    # Counts of parts and the hashes at the ends, of lines of a class that meet many others; pairs without them are left to the automaton.
    many = state.groupBy("key").agg(F.count(F.lit(1)).alias("lines")).where(F.col("lines") >= MANY).select("key")
    parts = state.where("own and code >= 0").join(_few(tables.put(many)), "key").select("h", "e", "wide").distinct().join(texts.select("h", "line"), "h")
    parts = tables.put(parts.select("h", "e", "wide", part_counts(F.col("line"), F.col("e"), F.col("wide")).alias("parts")))
    more = []
    for round_ in range(ROUNDS + 1):
        hot = F.col("lines") * F.col("unshifted") > (HOT**2 if round_ < ROUNDS else 2**62)
        sizes = state.groupBy("key").agg(F.count(F.lit(1)).alias("lines"), F.count_if("own").alias("index"), F.count_if(_unshifted(F.col("code"))).alias("unshifted"))
        sizes = tables.put(sizes.where("lines > 1 and index > 0 and unshifted > 0").select("key", hot.alias("hot")))
        here = tables.put(state.join(_few(sizes), "key"))
        # An entry without a code is a whole text, or one too short to be cut.
        meet = here.where("not hot or code < 0").select("key", "h", "own", _unshifted(F.col("code")).alias("unshifted"), "code", "e", "wide").join(_few(marks), "h")
        meet = meet.join(_few(parts), ["h", "e", "wide"], "left") if round_ == 0 else meet
        both = _side(meet.where("unshifted"), "a", "key").join(_side(meet, "b", "key"), "key")
        # Two that are both unshifted meet once; the shorter line has the key by its own class; the later one is open.
        order = (~F.col("unshifted_b") | (F.col("h_a") < F.col("h_b"))) & _alike(steps)
        order = order & ((F.col("own_a") & (F.col("size_a") <= F.col("size_b"))) | (F.col("own_b") & (F.col("size_b") <= F.col("size_a"))))
        order = order & F.when(F.col("first_a") > F.col("first_b"), F.col("open_a")).otherwise(F.col("open_b"))
        if round_ == 0:
            sides = F.col("parts_a"), F.col("parts_b"), F.col("e_a")
            order = order & F.when(F.col("own_a") & F.col("own_b"), F.coalesce(parts_alike(*sides) & found_here(*sides, F.col("code_a")), F.lit(True))).otherwise(True)
        more.append(tables.put(both.where(order).select("h_a", "h_b").distinct()))
        go_on = here.where("hot and code >= 0")
        if go_on.isEmpty():
            break
        state = _deeper(go_on, texts, tables)
    more = tables.put(functools.reduce(DataFrame.union, more).distinct())
    return tables.put(settled.union(_verified(more, texts, steps, tables)).distinct())


def dedup_lines(
    docs: DataFrame,
    *,
    edits: int | Sequence[tuple[int, int]] = 1,
    least: int = 20,
    exact_least: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` without lines that stood before, or stood before within ``edits`` edits.

    Lines are compared without white space at their ends and in lower case. Lines of at least
    ``exact_least`` characters (as ``least`` if not given; blank lines always stay) are compared as a
    whole, and those of at least ``least`` by edits, too. A line goes if an equal one stands before it in
    its document or in one of a smaller doc_id (null is smallest), or if its first place comes
    after that of another line within ``edits`` edits, whether or not that one goes itself;
    places are in the order of doc_id, a hash of the text, and position. Rows that share a
    doc_id don't take equal lines from one another; rows equal in id and text get the same result.
    ``edits`` is a number, or (least length, edits) for lines of that length on; of two lines
    the shorter one's holds.

    Returns all columns of ``docs``, ``text_col`` with the lines that stay, and before them
    a struct ``lines`` of longs: total, repeated, near, kept (it replaces a column of that name). Null texts stay null (0
    lines); if all lines go the text is empty; an empty table gives no rows. Texts and lines may be of any length.
    """
    steps, tables = steps_of(edits), Tables(docs.sparkSession)
    exact_least = max(1, least if exact_least is None else exact_least)
    d = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    base = docs.select(d.alias("d"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text")).where("text is not null")
    # Lines are cut out of texts once; later passes read what they need of this table.
    all_lines = tables.put(_lines(base, min(exact_least, max(1, least))).withColumn("n", F.length("line")), **{"parquet.enable.dictionary": "false"})
    near = near_lines(all_lines.where(F.col("n") >= least).drop("n"), steps, tables).withColumn("near", F.lit(True))
    thin = all_lines.where(F.col("n") >= exact_least).select("d", "t", "pos", "h", "g")
    # Lines of which something goes: those that stand in several places, and those near to an earlier one.
    repeats = thin.groupBy("h", "g").agg(F.min("d").alias("first_d"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    known = tables.put(repeats.join(near, ["h", "g"], "full").select("h", "g", "first_d", F.coalesce("near", F.lit(False)).alias("near")))
    in_doc = thin.join(_few(known), ["h", "g"]).groupBy("d", "t", "h", "g").agg(F.sort_array(F.collect_set("pos")).alias("places"), F.first("first_d").alias("first_d"), F.first("near").alias("near"))
    # In the first document of a line, only its first place is no repetition; that one goes if it is near to an earlier line.
    elsewhere = F.coalesce(F.col("d") != F.col("first_d"), F.lit(False))
    goes = F.when(elsewhere | F.col("near"), F.col("places")).otherwise(F.slice("places", 2, F.size("places")))
    in_doc = in_doc.select("d", "t", goes.alias("goes"), (F.col("near") & ~elsewhere).cast("long").alias("near")).where(F.size("goes") > 0)
    by_doc = in_doc.groupBy(F.col("d").alias("_d"), F.col("t").alias("_t")).agg(F.flatten(F.collect_list("goes")).alias("_gone"), F.sum("near").alias("_near"))
    by_doc = tables.put(by_doc)
    tables.drop_all_but(by_doc)
    # The row as a struct, so that no column of it can clash with those here.
    whole = docs.select(F.struct(*docs.columns).alias("_row"), d.alias("_d"), F.xxhash64(text_col).alias("_t")).join(by_doc.hint("shuffle_hash"), ["_d", "_t"], "left")
    text = F.col("_row")[text_col]
    stay = lambda parts: F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_gone")), lambda i: F.get(parts, i))
    kept = F.when(F.col("_gone").isNull(), text).otherwise(F.array_join(T.let(F.split(text, "\n", -1), stay), "\n"))
    went, near_ones = F.coalesce(F.size("_gone"), F.lit(0)).cast("long"), F.coalesce("_near", F.lit(0)).cast("long")
    went = F.when(F.col("_gone").isNull(), F.lit(0).cast("long")).otherwise(went)
    total = F.when(text.isNull(), F.lit(0)).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    lines = F.struct(total.alias("total"), (went - near_ones).alias("repeated"), near_ones.alias("near"), (total - went).alias("kept"))
    return whole.select(lines.alias("lines"), *[(kept if c == text_col else F.col("_row")[c]).alias(c) for c in docs.columns if c != "lines"])
