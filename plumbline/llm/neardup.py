"""Operator 7: near-duplicate documents by MinHash bands, odd sketches and full sets.

A document is the set of its word shingles, each a 64-bit hash. Documents with equal sets
are one class from the start. A class gets ``bands * rows`` MinHash samples and an odd
sketch: every sample, with its number, flips one bit of a bitmap, so the bits in which two
sketches differ estimate how many samples differ, most precisely where few do. Classes
whose samples agree on a whole band are candidates.

Candidates of a band's bucket are never listed as pairs of all with all. In the first wave the
most central class of a bucket, whose buckets are the largest, is its pivot, and all others are
compared with it: the exclusive or of two sketches rejects the hopeless (a second bitmap, of
all shingles, does so without loss), and what is left is confirmed on the full sets. Classes
that links join become one component. A pivot has met its whole bucket and leaves it, and a
bucket whose classes are in one component is finished, since no further link can change a
result. In the others the next wave takes pivots from outside the largest component, 32 at
first, then 32 times as many in each wave, until every bucket is finished. So a link that
matters is lost only where the bands or sketches miss it, and the number of waves grows with
the logarithm of a bucket. In the first wave rows of bands hold two numbers and no sketch;
later rows are of the few open buckets alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import Tables, WordCache, cut

#: Bytes that separate words; no byte of a longer UTF-8 character is among them.
SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
#: Bits of the bitmap that holds the parity of a full set's shingles.
PARITY = 1024
SIGNED = "doc_id long, n_shingles long, set_id long, bands array<long>, sketch array<long>"


class Shingler:
    """Hashed shingle sets, and samples and sketches of them."""

    def __init__(self, words: int, bands: int, rows: int, sketch_bits: int, seed: int = 20240607):
        self.words, self.bands, self.rows, self.bits = words, bands, rows, sketch_bits
        draw = np.random.default_rng(seed)
        self.by = draw.integers(1, 2**63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        self.plus = draw.integers(0, 2**63, bands * rows, np.uint64)
        self.mix = draw.integers(1, 2**63, max(words, rows), np.uint64) * np.uint64(2) + np.uint64(1)
        self.cache = WordCache(xxhash.xxh64_intdigest)

    def shingles(self, text: str | None) -> np.ndarray:
        """The sorted set; with fewer words than a shingle has, all words as one; empty without words."""
        cache = self.cache
        # bytes.lower changes A-Z alone
        words = (text or "").encode("utf-8", "surrogatepass").lower().translate(SPACES).split(b" ")
        h = np.array([cache[w] for w in words if w], np.uint64)
        if not len(h):
            return h
        n = min(self.words, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for j in range(n):
            out = _scramble((out ^ h[j : len(h) - n + 1 + j]) * self.mix[j])
        return np.unique(out)

    def signatures(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Band hashes and sketches, a row for each set; the sets must not be empty."""
        flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
        mins = np.empty((len(sets), self.bands * self.rows), np.uint64)
        for i, (by, plus) in enumerate(zip(self.by, self.plus, strict=True)):
            mins[:, i] = np.minimum.reduceat(flat * by + plus, starts)
        bits = _scramble(mins * self.by[::-1] + np.arange(mins.shape[1], dtype=np.uint64)) % np.uint64(self.bits)
        bitmap = np.zeros((len(sets), self.bits), np.uint8)
        np.bitwise_xor.at(bitmap, (np.arange(len(sets))[:, None], bits.astype(np.int64)), 1)
        owner = np.repeat(np.arange(len(sets)), np.diff([*starts, len(flat)]))
        parity = np.bincount(owner * PARITY + (_scramble(flat) % np.uint64(PARITY)).astype(np.int64), minlength=len(sets) * PARITY) & 1
        bitmap = np.concatenate([bitmap, parity.reshape(len(sets), PARITY).astype(np.uint8)], axis=1)
        sketch = np.packbits(bitmap, axis=1).view(np.int64)
        band = np.zeros((len(sets), self.bands), np.uint64)
        for j in range(self.rows):
            band = _scramble((band ^ mins[:, j :: self.rows]) * self.mix[j])
        return _scramble(band + np.arange(self.bands, dtype=np.uint64)).view(np.int64), sketch


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def odd_sketch_limit(samples: int, bits: int, similarity: float, sigmas: float = 4.5) -> int:
    """Most bits in which sketches of sets this similar differ, ``sigmas`` deviations over the mean.

    Of ``samples`` MinHash samples a share of ``1 - similarity`` differs, and each that does
    flips two bits, so ``bits / 2 * (1 - (1 - 2 / bits) ** (2 m))`` differ for ``m`` samples.
    Both the number of samples that differ and the places of their flips vary.
    """
    m = samples * (1 - similarity)
    kept = (1 - 2 / bits) ** (2 * m)
    by_samples = 2 * kept * (m * similarity) ** 0.5
    by_places = max(0.0, bits / 4 * (1 + (bits - 1) * (1 - 4 / bits) ** (2 * m) - bits * kept**2)) ** 0.5
    return int(np.ceil(bits / 2 * (1 - kept) + sigmas * (by_samples**2 + by_places**2) ** 0.5))


def odd_sketch_similarity(differing: int, samples: int, bits: int) -> float:
    """The similarity that ``differing`` bits of two odd sketches speak for."""
    share = min(differing / bits, 0.4999)
    return max(0.0, 1 + bits / (4 * samples) * float(np.log(1 - 2 * share)))


def bits_apart(a: Column, b: Column, places: range) -> Column:
    """Bits in which two sketches, arrays of longs, differ in these places."""
    total = F.lit(0)
    for i in places:
        total = total + F.bit_count(F.get(a, i).bitwiseXOR(F.get(b, i)))
    return total


def may_be_alike(a: Column, b: Column, sizes: Column, bits: int, limit: int, percent: int) -> Column:
    """Whether two sketches let a pair pass whose sets have ``sizes`` shingles in all.

    The odd sketches' limit comes first. A shingle in one set alone flips one bit of the
    parity bitmaps, so at least as many shingles differ as bits do, and a similarity in
    percent allows ``sizes * (100 - percent) / (100 + percent)`` of them: no link is lost there.
    """
    words = bits // 64
    odd = bits_apart(a, b, range(words)) <= limit
    return odd & ((100 + percent) * bits_apart(a, b, range(words, words + PARITY // 64)) <= (100 - percent) * sizes)


def signed(rows: DataFrame, settings: tuple) -> DataFrame:
    """doc_id, n_shingles, set_id (a hash of the set), bands and sketch of rows (doc_id, text)."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(*settings)
        for whole in batches:
            for at in range(0, len(whole), 256):
                pdf = whole.iloc[at : at + 256]
                sets = [shingler.shingles(t) for t in pdf["text"]]
                full = [i for i, s in enumerate(sets) if len(s)]
                bands: list = [None] * len(sets)
                sketches: list = [None] * len(sets)
                if full:
                    for i, *bands_sketch in zip(full, *shingler.signatures([sets[i] for i in full]), strict=True):
                        bands[i], sketches[i] = bands_sketch
                sizes, ids = [len(s) for s in sets], pd.array([set_id(s) for s in sets], "Int64")
                yield pd.DataFrame({"doc_id": pdf["doc_id"].array, "n_shingles": sizes, "set_id": ids, "bands": bands, "sketch": sketches})

    return rows.mapInPandas(sign, SIGNED)


def set_id(shingles: np.ndarray) -> int | None:
    """A signed 64-bit hash of a set, null for the empty one."""
    return xxhash.xxh64_intdigest(shingles.tobytes()) - 2**63 if len(shingles) else None


def full_sets(rows: DataFrame, settings: tuple) -> DataFrame:
    """doc_id, set_id and shingles of rows (doc_id, text)."""

    def shingle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(*settings)
        for whole in batches:
            for at in range(0, len(whole), 256):
                pdf = whole.iloc[at : at + 256]
                sets = [shingler.shingles(t) for t in pdf["text"]]
                yield pd.DataFrame({"doc_id": pdf["doc_id"].array, "set_id": pd.array([set_id(s) for s in sets], "Int64"), "shingles": [s.view(np.int64) for s in sets]})

    return rows.mapInPandas(shingle, "doc_id long, set_id long, shingles array<long>")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component): the smallest node each node reaches by ``links`` (a, b).

    In each round every node takes the smallest label among its own and its neighbours',
    then that label's label. Labels are written as a table in each round, and rounds end when
    nothing changes; nodes without links keep themselves.
    """
    tables = Tables(nodes.sparkSession)
    both = tables.put(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = tables.put(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("component"), F.lit(True).alias("new")))
    changed = not labels.isEmpty()
    while changed:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("c")), "b").groupBy("a").agg(F.min("c").alias("c"))
        step = labels.join(near, labels.node == near.a).select("node", F.least("component", "c").alias("now"), F.col("component").alias("old"))
        # A label is itself a node, whose own label may be smaller still.
        jump = labels.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        before, now = labels, F.least("now", "_c")
        labels = tables.put(step.join(jump, step.now == F.col("_n")).select("node", now.alias("component"), (now != F.col("old")).alias("new")))
        tables.drop(before)
        changed = not labels.where("new").isEmpty()
    tables.drop(both)
    return nodes.join(labels.drop("new"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def near_duplicates(
    docs: DataFrame,
    *,
    words: int = 5,
    similarity: float = 0.8,
    bands: int = 28,
    rows: int = 5,
    sketch_bits: int = 512,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of at least ``similarity``.

    Returns one row per row of ``docs``: doc_id, n_shingles, component_id (the smallest
    doc_id reachable over links, its own included), kept (doc_id = component_id). A text is
    lower-cased in A-Z and split at ASCII white space; null, empty and blank texts have the
    empty set and link with nothing. Every link is confirmed on the full sets, and a null
    doc_id belongs to no component (component_id null, kept false). Rows that share a
    doc_id are one document if their sets are equal; else each has its component, and both
    are kept if both are least. An empty table gives no rows.

    At the defaults a pair of exactly 0.8 shares no band with probability 1.5e-5 (28 bands of
    five samples), and sketches reject it 4.5 deviations above their mean. Classes of equal
    sets pass through as one row, shingle sets are moved only for classes that share a band.
    A text of any length is one row of its task, whose set takes eight bytes for each word.
    """
    settings, limit = (words, bands, rows, sketch_bits), odd_sketch_limit(bands * rows, sketch_bits, similarity)
    percent, tables = round(similarity * 100), Tables(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sign = cut(signed(texts, settings))
    # Equal sets are one class, a node named by its set_id, as texts of one doc_id may differ; its smallest doc_id comes in at the end.
    first = [F.first(c).alias(n) for c, n in (("n_shingles", "size"), ("bands", "bands"), ("sketch", "sketch"))]
    known = sign.where("set_id is not null and doc_id is not null")
    classes = cut(known.groupBy(F.col("set_id").alias("node")).agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), *first))
    state = _shared(classes, tables)
    nodes = tables.put(classes.drop("bands").join(state.select("node").distinct(), "node", "left_semi"))
    labels, sets, wave = None, None, 0
    while True:
        rows, pivots = _pivots(state, labels, wave, tables)
        if rows is None:
            break
        if wave == 0:
            near = rows.join(pivots, "band").where("component <> pivot_component").select("pivot", "node").distinct()
            pairs = tables.put(_may_link(near, nodes, sketch_bits, limit, percent))
        else:
            # Few buckets are open, but many classes of one may be strange to all others: sketches come along, so that no pair is listed that they reject.
            sketched = _sketched(pivots, "pivot", nodes).select("band", "pivot", "pivot_component", "_sketch_pivot", "_size_pivot")
            alike = may_be_alike(F.col("_sketch_node"), F.col("_sketch_pivot"), F.col("_size_node") + F.col("_size_pivot"), sketch_bits, limit, percent)
            sides = tables.put(_sketched(rows, "node", nodes)), tables.put(sketched)
            pairs = tables.put(sides[0].join(sides[1], "band").where((F.col("component") != F.col("pivot_component")) & alike).select("pivot", "node").distinct())
            tables.drop(*sides)
        left = tables.put(rows.join(pivots.select("band", F.col("pivot").alias("node")), ["band", "node"], "left_anti").select("band", "node", "weight"))
        tables.drop(state, rows, pivots)
        state = left
        if not pairs.isEmpty():
            if sets is None:
                # Pairs of later waves are of classes that are left in an open bucket.
                later = state.join(state.groupBy("band").agg(F.count(F.lit(1)).alias("left")).where("left > 1"), "band")
                sets = _sets_of(pairs.select(F.col("pivot").alias("node")).union(pairs.select("node")).union(later.select("node")), nodes, texts, settings, tables)
            found = tables.put(_confirmed(pairs, sets, percent, tables))
            if not found.isEmpty():
                before, labels = labels, _joined(labels, found, tables)
                tables.drop(before)
            tables.drop(found)
        tables.drop(pairs)
        wave += 1
    tables.drop(state, nodes, sets)
    named = classes.select("node", "least", "copies")
    if labels is None:
        named = named.where("copies > 1").select(F.col("node").alias("set_id"), F.col("least").alias("component_id"))
    else:
        named = tables.put(named.join(labels, "node", "left").where("copies > 1 or component is not null").select("node", "least", F.coalesce("component", "node").alias("component")))
        least = tables.put(named.groupBy("component").agg(F.min("least").alias("component_id")))
        named = named.join(least, "component").select(F.col("node").alias("set_id"), "component_id")
    named = tables.put(named)
    out = sign.select("doc_id", "n_shingles", "set_id").join(named, "set_id", "left")
    # An empty set is a component of its own; so is nothing whose id is null.
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def without_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", **settings) -> DataFrame:
    """The rows of ``docs`` but those whose component keeps another document; rows without an id stay."""
    found = near_duplicates(docs, id_col=id_col, **settings)
    gone = found.where("doc_id is not null and not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == F.col("_gone"), "left_anti")


#: Waves that take one pivot for each unfinished bucket, before they take more and more.
WAVES = 1
#: Most documents whose ids are broadcast to pick up their texts; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 500_000


def _shared(classes: DataFrame, tables: Tables) -> DataFrame:
    """(band, node, weight) of bands that several classes share; a class's weight is the sum of its buckets' sizes."""
    rows = classes.select("node", F.explode("bands").alias("band"))
    # As tables of their own, aggregates are plain sides of joins, in which adaptive execution can split a hot band.
    members = tables.put(rows.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    shared = tables.put(rows.join(members, "band"))
    weights = shared.groupBy("node").agg(F.sum("members").alias("weight"))
    state = tables.put(shared.join(weights, "node").select("band", "node", "weight"))
    tables.drop(members, shared)
    return state


def _pivots(state: DataFrame, labels: DataFrame | None, wave: int, tables: Tables) -> tuple[DataFrame | None, DataFrame | None]:
    """(rows of unfinished buckets with their component, this wave's pivots there); None if all are finished."""
    component = F.col("node") if labels is None else F.coalesce("component", "node")
    rows = (state if labels is None else state.join(labels, "node", "left")).withColumn("component", component)
    named = [F.col("node").alias("pivot"), F.col("component").alias("pivot_component")]
    if wave == 0:
        central = rows.groupBy("band").agg(F.max(F.struct("weight", "node")).alias("p"))
        pivots = tables.put(central.select("band", F.col("p.node").alias("pivot"), F.col("p.node").alias("pivot_component")))
        return (None, None) if pivots.isEmpty() else (rows, pivots)
    rows = tables.put(rows)
    sizes = rows.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
    unfinished = sizes.groupBy("band").agg(F.max(F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    unfinished = tables.put(unfinished.select("band", F.col("main.component").alias("main")))
    if unfinished.isEmpty():
        return None, None
    all_rows, rows = rows, tables.put(rows.join(unfinished, "band"))
    tables.drop(all_rows, unfinished)
    order = Window.partitionBy("band").orderBy(F.desc("weight"), "node")
    rest = rows.where("component <> main").withColumn("place", F.row_number().over(order)).where(F.col("place") <= 32 ** max(0, wave - WAVES + 1))
    return rows, tables.put(rest.select("band", *named))


def _sketched(rows: DataFrame, name: str, nodes: DataFrame) -> DataFrame:
    """``rows`` with size and sketch of the class in column ``name``."""
    return rows.join(nodes.select(F.col("node").alias(name), F.col("size").alias(f"_size_{name}"), F.col("sketch").alias(f"_sketch_{name}")), name)


def _may_link(pairs: DataFrame, nodes: DataFrame, bits: int, limit: int, percent: int) -> DataFrame:
    """The pairs (pivot, node) whose sketches speak for a link or leave it open."""
    both = _sketched(_sketched(pairs, "node", nodes), "pivot", nodes)
    return both.where(may_be_alike(F.col("_sketch_node"), F.col("_sketch_pivot"), F.col("_size_node") + F.col("_size_pivot"), bits, limit, percent)).select("pivot", "node")


def _sets_of(wanted: DataFrame, nodes: DataFrame, texts: DataFrame, settings: tuple, tables: Tables) -> DataFrame:
    """(id, shingles) of the classes ``wanted``, of the text of their smallest doc_id."""
    wanted = tables.put(nodes.join(wanted.distinct(), "node", "left_semi").select(F.col("node").alias("set_id"), F.col("least").alias("doc_id")))
    n = wanted.count()
    few = F.broadcast if n <= BROADCAST_ROWS else lambda df: df
    sets = full_sets(texts.join(few(wanted.select("doc_id").distinct()), "doc_id", "left_semi"), settings).where("set_id is not null")
    sets = tables.put(sets.join(few(wanted), ["doc_id", "set_id"]).select(F.col("set_id").alias("id"), "shingles"))
    # Only rows equal in id and set give one twice; sets are not moved to look for it.
    return sets if sets.count() == n else tables.put(sets.dropDuplicates(["id"]))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, tables: Tables) -> DataFrame:
    """The pairs whose full sets are similar enough; a pivot's pairs are dealt over several tasks before sets join them.

    Up to ``BROADCAST_ROWS`` pairs go to the sets, so that a wave moves a node's set for each of its pairs and its pivots' sets alone.
    """
    salts = tables.put(pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / 512).cast("int").alias("_salts")))
    few = F.broadcast if pairs.count() <= BROADCAST_ROWS else lambda df: df
    dealt = pairs.join(few(salts), "pivot").select("pivot", "node", F.pmod(F.xxhash64("node"), F.col("_salts")).cast("int").alias("_salt"))
    pivots = sets.withColumnsRenamed({"id": "pivot", "shingles": "_b"}).join(few(salts), "pivot").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    both = sets.withColumnsRenamed({"id": "node", "shingles": "_a"}).join(few(dealt), "node").join(pivots.drop("_salts"), ["pivot", "_salt"])
    shared = F.size(F.array_intersect("_a", "_b"))
    return both.where(100 * shared >= percent * (F.size("_a") + F.size("_b") - shared)).select("pivot", "node")


def _joined(labels: DataFrame | None, found: DataFrame, tables: Tables) -> DataFrame:
    """(node, component) of all linked nodes, when ``found`` links (pivot, node) come to what ``labels`` has linked."""
    links = found.select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    if labels is not None:
        of = lambda end: labels.select(F.col("node").alias(end), F.col("component").alias(f"_{end}"))
        links = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
        links = tables.put(links.where("a <> b").distinct())
    met = tables.put(components(links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct(), links))
    if labels is None:
        return met
    now = met.select(F.col("node").alias("component"), F.col("component").alias("_now"))
    old = labels.join(now, "component", "left").select("node", F.coalesce("_now", "component").alias("component"))
    return tables.put(old.union(met).distinct())
