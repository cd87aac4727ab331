"""Fact tables as edges of typed graphs, and lookups over two hops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edges(facts: DataFrame, key: str, graph: str, subject: Column, relation: Column, target: Column, negated: Column) -> DataFrame:
    """(key, graph, src, dst, relation, polarity) of one graph; rows without both ends are left out."""
    rows = facts.select(key, F.lit(graph).alias("graph"), subject.alias("src"), target.alias("dst"), relation.alias("relation"), F.when(negated, "NOT").otherwise("+").alias("polarity"))
    return rows.where("src is not null and dst is not null")


def two_hops(mentions: DataFrame, graph: DataFrame, key: str) -> DataFrame:
    """(key, entity, target, verdict) for mentions (key, entity, action, target): entity -> action -> target in the edges.

    grounded where the whole path is there, flagged where a NOT edge stands in it or the entity
    does the action to others alone, unknown otherwise.
    """
    e = graph.select(F.col(key).alias("_k"), F.col("src").alias("_s"), F.col("relation").alias("_r"), F.col("dst").alias("_d"), "polarity")
    j = mentions.join(e, (F.col(key) == F.col("_k")) & (F.lower("entity") == F.lower("_s")) & (F.lower("action") == F.lower("_r")), "left")
    hit = F.lower("_d") == F.lower("target")
    by = j.groupBy(key, "entity", "action", "target").agg(F.coalesce(F.bool_or(hit & (F.col("polarity") == "+")), F.lit(False)).alias("whole"), F.coalesce(F.bool_or(hit & (F.col("polarity") == "NOT")), F.lit(False)).alias("denied"), F.count("_s").alias("n"))
    return by.select(key, "entity", "action", "target", F.when(F.col("denied"), "flagged").when(F.col("whole"), "grounded").when(F.col("n") > 0, "flagged").otherwise("unknown").alias("verdict"))
