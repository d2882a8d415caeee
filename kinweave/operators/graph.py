"""Colour refinement and connected components on graphs of any size, one written table a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.sources import tables

DIGEST = "sha256 of the node's own colour and its neighbours' colours"


def refine(nodes: DataFrame, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """Colours of each round: round, id, colour, is_member, of nodes (id, is_member, anchor) and edges (src, dst, count).

    Round 0: an anchor's own colour, or a member's self count and number of targets. Each next colour is that of
    the node with the multiset of its targets' colours; nodes without targets take their sources' instead. Edges to
    itself count in round 0 only. Stops with the first round that splits nothing (that round is kept), or
    after ``rounds``. A colour is a digest, so equal colours mean equal unfoldings in every run.
    """
    spark = nodes.sparkSession
    ids = nodes.select("id")
    inner = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    other = tables.keep(inner.where("src <> dst").select("src", "dst", "count"), "refine-edges")
    own = inner.where("src = dst").select(F.col("src").alias("id"), F.col("count").alias("_self"))
    out = other.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("_out"))
    start = nodes.join(own, "id", "left").join(out, "id", "left").withColumn("_out", F.coalesce("_out", F.lit(0)))
    colour = F.when(F.col("is_member"), F.concat_ws(":", F.lit("member"), F.coalesce("_self", F.lit(0)), "_out")).otherwise(F.concat(F.lit("anchor:"), F.coalesce("anchor", "id")))
    now = tables.keep(start.select("id", "is_member", (F.col("_out") == 0).alias("sink"), F.sha2(colour, 256).alias("colour")), "refine-0")
    done = [now.select(F.lit(0).alias("round"), "id", "colour", "is_member")]
    n = now.select("colour").distinct().count()
    k = 0
    while rounds is None or k < rounds:
        k += 1
        c = now.select("id", "colour")
        seen = other.join(c.select(F.col("id").alias("dst"), F.col("colour").alias("_c")), "dst").select(F.col("src").alias("id"), "_c", "count", F.lit(False).alias("_in"))
        sinks = now.where("sink").select(F.col("id").alias("dst"))
        back = other.join(sinks, "dst", "left_semi").join(c.select(F.col("id").alias("src"), F.col("colour").alias("_c")), "src").select(F.col("dst").alias("id"), "_c", "count", F.lit(True).alias("_in"))
        # summed by colour before anything is gathered: a node's list is as long as its neighbours' colours are many
        sums = seen.union(back).groupBy("id", "_in", "_c").agg(F.sum("count").alias("n"))
        around = sums.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("_in", "_c", "n"))).alias("_around"))
        new = now.join(around, "id", "left").select("id", "is_member", "sink", F.sha2(F.concat("colour", F.coalesce(F.to_json("_around"), F.lit("[]"))), 256).alias("colour"))
        now = tables.keep(new, f"refine-{k}")
        done.append(now.select(F.lit(k).alias("round"), "id", "colour", "is_member"))
        m = now.select("colour").distinct().count()
        if m == n:
            break
        n = m
    everything = done[0]
    for d in done[1:]:
        everything = everything.unionByName(d)
    return everything if done else spark.createDataFrame([], "round int, id string, colour string, is_member boolean")


def clusters(colours: DataFrame) -> DataFrame:
    """round, cluster (C1, C2, ... by least member), id of the members of each round."""
    from pyspark.sql.window import Window

    own = colours.where("is_member")
    least = own.groupBy("round", "colour").agg(F.min("id").alias("first"))
    named = least.withColumn("cluster", F.concat(F.lit("C"), F.row_number().over(Window.partitionBy("round").orderBy("first"))))
    return own.join(named, ["round", "colour"]).select("round", "cluster", "id")


def stars(pairs: DataFrame) -> DataFrame:
    """u, v: every node of pairs (u, v) that isn't the least of its component, with that least one.

    Alternates large stars and small stars until nothing changes; of the rounds that are written only the last stays.
    """
    edges = pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    rounds, before = tables.Rounds(pairs.sparkSession, "stars"), None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        edges = rounds.keep(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges
        before = now


def components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, component (its least id) of all nodes (id); pairs (first, second)."""
    found = stars(pairs.select(F.col("first").alias("u"), F.col("second").alias("v")))
    return nodes.select("id").join(found.select(F.col("u").alias("id"), F.col("v").alias("_root")), "id", "left").select("id", F.coalesce("_root", "id").alias("component"))


def signatures(edges: DataFrame, colours: DataFrame) -> DataFrame:
    """id, out_signature, in_signature: sorted arrays of (descriptor, count) of what a node reaches and what reaches it.

    The descriptor is the other end's colour (id, colour), or 'external' if it has none.
    """
    c = colours.select("id", "colour")

    def side(node: str, far: str, name: str) -> DataFrame:
        rows = edges.join(c.withColumnRenamed("id", far), far, "left").select(F.col(node).alias("id"), F.struct(F.coalesce("colour", F.lit("external")).alias("descriptor"), F.col("count").alias("count")).alias("e"))
        return rows.groupBy("id").agg(F.array_sort(F.collect_list("e")).alias(name))

    return side("src", "dst", "out_signature").join(side("dst", "src", "in_signature"), "id", "full_outer")
