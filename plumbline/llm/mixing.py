"""Operator 8: mixing sources to target weights by Sainte-Lague apportionment.

A token budget is divided into equal blocks, and the blocks are apportioned to sources,
and each source's blocks to its shards, by highest quotients ``target / (2k - 1)``. The
quotients that can win a last seat are few and found without listing all seats: with
``n`` seats and ``s`` parties, the divisor lies between ``total / (n + s)`` and
``total / (n - s)``, every party surely has its seats at the larger one, and at most
``3 s`` quotients lie between, which are ranked.

A shard's documents stand in a seeded order, as a stream of blocks. It is taken as many
whole times as its quota holds, and for the rest a run of consecutive blocks from a seeded
place on, round the end; since the order is seeded, the run is a random set of documents,
of which only the two at its ends are cut. What a document gives is a difference of two
prefix sums in closed form, so no block is ever a row. All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import WORD, Tables


def word_count(text: Column) -> Column:
    """Number of words of ``text``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def capped_targets(sources: DataFrame, share: float, cap: float) -> DataFrame:
    """Adds ``target``: ``share`` of all sizes by ``weight``, at most ``cap`` times ``source_size``.

    The excess of capped sources is reshared by weight until none is above. Ordered by
    ``cap * size / weight``, sources are capped from the smallest on, and the first that
    stays below with what is left then ends it, so prefix sums over the sources decide it.
    One row per source; only this small table is ordered as a whole.
    """
    by = Window.orderBy(F.col("_ratio"), F.col("source_rank"))
    ahead, everything = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.lit(share) * F.sum("source_size").over(everything).cast("double")
    capped = F.lit(cap) * F.coalesce(F.sum("source_size").over(ahead), F.lit(0)).cast("double")
    weights = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(ahead), F.lit(0))
    level = sources.withColumn("_ratio", F.lit(cap) * F.col("source_size") / F.col("weight")).withColumn("_level", (total - capped) / weights)
    # The level falls below the ratio at the first source that is not capped; from there on all have that level.
    free = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "source_rank", "_level"))).over(everything)
    return (
        level.withColumn("_free", free)
        .withColumn(
            "target",
            F.when(
                F.col("_free").isNotNull() & (F.struct("_ratio", "source_rank") >= F.struct(F.col("_free._ratio").alias("_ratio"), F.col("_free.source_rank").alias("source_rank"))),
                F.col("weight") * F.col("_free._level"),
            ).otherwise(F.lit(cap) * F.col("source_size")),
        )
        .drop("_ratio", "_level", "_free")
    )


def apportion(parties: DataFrame, votes: str, seats: str, group: list[str], key: list[str]) -> DataFrame:
    """Adds ``quota``: the ``seats`` of each ``group`` given to its parties by highest quotients.

    ``votes`` is a party's non-negative weight, ``seats`` the group's number of seats,
    repeated in each row, and ``key`` orders parties whose quotients are equal. A group
    whose votes are all 0 gets no seats.
    """
    everything = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    p = parties.withColumn("_total", F.sum(votes).over(everything).cast("double")).withColumn("_s", F.count(F.lit(1)).over(everything))
    at = lambda seat: F.when(F.col("_total") > 0, F.floor(F.col(votes) * seat / F.col("_total") + 0.5)).otherwise(0).cast("long")
    p = p.withColumn("_low", at(F.greatest(F.col(seats) - F.col("_s"), F.lit(0)).cast("double"))).withColumn("_high", at((F.col(seats) + F.col("_s")).cast("double")))
    p = p.withColumn("_left", F.col(seats) - F.sum("_low").over(everything))
    last = p.where(F.col("_high") > F.col("_low")).withColumn("_k", F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))))
    by = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy(F.desc(F.col(votes) / (2 * F.col("_k") - 1)), *key, "_k")
    won = last.withColumn("_place", F.row_number().over(by)).where(F.col("_place") <= F.col("_left")).groupBy(*group, *key).agg(F.count(F.lit(1)).alias("_won"))
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"w.{c}")) for c in dict.fromkeys([*group, *key])]
    on = same[0]
    for s in same[1:]:
        on = on & s
    joined = p.alias("p").join(won.alias("w"), on, "left")
    keep = [F.col(f"p.{c}") for c in parties.columns]
    return joined.select(*keep, (F.col("p._low") + F.coalesce(F.col("w._won"), F.lit(0))).alias("quota"))


def mix(
    docs: DataFrame,
    *,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    block: int = 16,
    shard_rows: int = 2_000,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: bool = False,
) -> DataFrame:
    """What a mix takes of each document, in words.

    Sources by code point, null last, have the ``weights`` in turn and share ``share`` times
    all words; a target stops at ``cap`` times its source's size. Returns doc_id, source,
    shard, size, source_size, target, quota (blocks of the shard) and taken: at most
    ``ceil(cap)`` times the size for every document, and for each source within a few
    blocks for each of its shards of the target. With ``carry`` the whole row of ``docs``
    comes along as a struct, ``row``. Empty and null texts have size 0 and give 0; a null
    source is a source; rows with equal or null ids are told apart by their text's hash,
    and equal rows of both share what is taken in either order. Reruns agree, whatever the
    partitioning. An empty table gives no rows.
    """
    seeded = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        F.coalesce(F.crc32(F.col(text_col)), F.lit(-1)).alias("_text"),
        seeded.alias("_order"),
        *([F.struct(*docs.columns).alias("row")] if carry else []),
    )
    # Words are counted once: a table without texts serves all sums, and the mix itself unless texts come along.
    thin = Tables(docs.sparkSession).put(rows.drop("row"))
    sources = thin.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    sources = sources.withColumn("source_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("source_rank") - 1) % len(weights) + 1).cast("int"))
    sources = capped_targets(sources.withColumn("weight", weight), share, cap)
    everything = Window.partitionBy(F.lit(0))
    sources = sources.withColumn("_seats", F.round(F.sum("target").over(everything) / block).cast("long"))
    sources = apportion(sources, "target", "_seats", [], ["source_rank"]).withColumnRenamed("quota", "_blocks")
    sources = sources.withColumn("_shards", F.ceil(F.col("_rows") / shard_rows).cast("long")).select("source", "source_size", "source_rank", "target", "_blocks", "_shards")
    shard = F.pmod(F.conv(F.substring("_order", 1, 8), 16, 10).cast("long"), F.col("_shards"))
    placed = lambda r: r.alias("r").join(sources.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")), "left").drop(F.col("s.source")).withColumn("shard", shard)
    rows = placed(rows if carry else thin)
    shards = placed(thin).groupBy("source_rank", "shard", "_blocks").agg(F.sum("size").alias("_size"))
    shards = apportion(shards, "_size", "_blocks", ["source_rank"], ["shard"]).drop("_blocks")
    by = Window.partitionBy("source_rank", "shard").orderBy("_order", F.col("doc_id"), "_text", "size")
    before = F.coalesce(F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_start", before).withColumn("_end", F.col("_start") + F.col("size"))
    rows = rows.join(shards, ["source_rank", "shard"])
    n = F.col("_size")
    wanted = F.least(F.col("quota") * block, F.ceil(F.lit(cap) * n).cast("long"))
    rows = rows.withColumn("_wanted", wanted)
    whole = F.when(n > 0, F.floor(F.col("_wanted") / n)).otherwise(0).cast("long")
    rest = F.col("_wanted") - whole * n
    place = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("source_rank"), F.col("shard"))), 1, 8), 16, 10).cast("long") * block, n)
    rows = rows.withColumn("_from", F.when(n > 0, place).otherwise(0)).withColumn("_rest", rest)
    overlap = lambda low, high: F.greatest(F.lit(0), F.least(F.col("_end"), high) - F.greatest(F.col("_start"), low))
    run_end = F.col("_from") + F.col("_rest")
    taken = whole * F.col("size") + overlap(F.col("_from"), F.least(run_end, n)) + overlap(F.lit(0), run_end - n)
    return rows.select("doc_id", "source", "shard", "size", "source_size", "target", "quota", taken.cast("long").alias("taken"), *(["row"] if carry else []))


def mixed_documents(docs: DataFrame, *, text_col: str = "text", length_col: str | None = "n_chars", **settings) -> DataFrame:
    """The mix itself: every document as often as :func:`mix` takes it, with the columns of ``docs``.

    A document whose words are taken once or twice is there once or twice; of the few that are
    cut at the ends of a shard's run, one row more has the first words of the rest. Documents
    of which nothing is taken are not there. ``length_col``, if it is there, is set to the
    number of code points.
    """
    rows = mix(docs, text_col=text_col, carry=True, **settings)
    words = F.regexp_extract_all(F.col("row")[text_col], F.lit(r"(?s)[\x20\x09-\x0D]*" + WORD), F.lit(0))
    whole, rest = F.floor(F.col("taken") / F.col("size")).cast("int"), (F.col("taken") % F.col("size")).cast("int")
    copies = F.concat(F.array_repeat(F.col("row")[text_col], whole), F.when(rest > 0, F.array(F.array_join(F.slice(words, 1, rest), ""))).otherwise(F.array().cast("array<string>")))
    rows = rows.where("taken > 0").select("row", F.explode(copies).alias("_text"))
    new = {text_col: F.col("_text")} | ({length_col: F.length("_text").cast("long")} if length_col in docs.columns else {})
    return rows.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
