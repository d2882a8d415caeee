"""From sources of functions and transfers to a classified call graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinweave.functions import scalars as S

#: Least width of an interval bucket, in units of the position.
BUCKET = 4096


def merge_sources(*sources: DataFrame) -> DataFrame:
    """One row an address from functions of several sources, the first source first.

    The first source's columns win; a size that isn't positive is filled from the next source that has one; the
    names of all sources are joined by '+', each once. One shuffle, whatever the number of sources.
    """
    ranked = None
    for i, s in enumerate(sources):
        own = s.select(F.lit(i).alias("_rank"), "address", "size", "name", "boundary_source", "kind")
        ranked = own if ranked is None else ranked.unionByName(own)
    entry = F.struct("_rank", "size", "name", "boundary_source", "kind")
    rows = ranked.groupBy("address").agg(F.array_sort(F.collect_list(entry)).alias("_all"))
    first = F.col("_all")[0]
    sized = F.filter("_all", lambda x: x["size"] > 0)
    names = F.array_distinct(F.flatten(F.transform("_all", lambda x: F.split(x["boundary_source"], r"\+"))))
    return rows.select("address", F.when(F.size(sized) > 0, F.get(sized, F.lit(0))["size"]).otherwise(first["size"]).alias("size"), first["name"].alias("name"), F.array_join(names, "+").alias("boundary_source"), first["kind"].alias("kind"))


def locate(points: DataFrame, intervals: DataFrame, point: str, start: str, size: str, keep: list[str], bucket: int = BUCKET, order: str | None = None) -> DataFrame:
    """Each point with the columns ``keep`` of the interval [start, start + size) that holds it, or nulls.

    An interval that starts at the point comes first, whatever its size, then the first that holds it by the column
    ``order`` (default: its start). A range join by buckets: an interval is copied to the buckets of ``bucket`` units
    that it touches, a point belongs to one, and the join is an equality that any join strategy can run. Intervals
    much longer than a bucket go by powers of two of it, so that each makes at most two copies.
    """
    long_ = lambda c: c.cast("long")
    level = F.greatest(F.ceil(F.log2(F.greatest(F.col(size), F.lit(1)) / bucket)), F.lit(0)).cast("int")
    at = lambda value, lv: F.floor(long_(value) / (F.lit(bucket) * F.pow(F.lit(2.0), lv))).cast("long")
    found = intervals.select(F.col(start).alias("_start"), F.col(size).alias("_size"), F.struct(order or start, start).alias("_order"), F.struct(*keep).alias("_kept"), level.alias("_level"))
    spans = found.where("_size > 0")
    first, last = at(F.col("_start"), F.col("_level")), at(F.col("_start") + F.col("_size") - 1, F.col("_level"))
    spans = spans.withColumn("_bucket", F.explode(F.sequence(first, last)))
    exact = found.groupBy("_start").agg(F.min_by("_kept", "_order").alias("_own"))
    levels = spans.select("_level").distinct()
    # at most some sixty rows: one for each doubling of an interval's length that occurs
    asked = points.withColumn("_row", F.monotonically_increasing_id())
    probe = asked.select("_row", F.col(point).alias("_point")).join(F.broadcast(levels)).withColumn("_bucket", at(F.col("_point"), F.col("_level")))
    hits = probe.join(spans, ["_level", "_bucket"]).where("_point >= _start AND _point < _start + _size")
    best = hits.groupBy("_row").agg(F.min_by("_kept", "_order").alias("_first"))
    out = asked.join(best, "_row", "left").join(exact, F.col(point) == F.col("_start"), "left")
    picked = F.coalesce("_own", "_first")
    return out.select(*points.columns, *(picked[k].alias(k if k not in points.columns else f"found_{k}") for k in keep))


def latest_per_site(transfers: DataFrame, order: str) -> DataFrame:
    """Of transfers at one (source, callsite), the one with the greatest ``order``."""
    rank = F.row_number().over(Window.partitionBy("source", "callsite").orderBy(F.col(order).desc()))
    return transfers.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def classify_targets(transfers: DataFrame, functions: DataFrame) -> DataFrame:
    """Adds status: resolved if the target is a function, unmapped if not, unresolved without a target."""
    known = functions.select(F.col("address").alias("target"), F.lit(True).alias("_known")).distinct()
    status = F.when(F.col("target").isNull(), "unresolved").when(F.col("_known"), "resolved").otherwise("unmapped")
    return transfers.join(known, "target", "left").withColumn("status", status).drop("_known")


def resolve_indirect(transfers: DataFrame, possible: DataFrame, seen: DataFrame) -> DataFrame:
    """Unresolved transfers by memory or register get the one target that analysis found for their site.

    possible: source, callsite, target. seen: source, callsite. Adds possible_targets and resolution:
    resolved-singleton, multiple-targets, unresolvable-target or not-seen.
    """
    sets = possible.groupBy("source", "callsite").agg(F.array_sort(F.collect_set("target")).alias("_targets"))
    rows = transfers.join(sets, ["source", "callsite"], "left").join(seen.select("source", "callsite").distinct().withColumn("_seen", F.lit(True)), ["source", "callsite"], "left")
    open_ = (F.col("status") == "unresolved") & F.col("operand_kind").isin("memory", "register")
    n = F.coalesce(F.size("_targets"), F.lit(0))
    single = open_ & (n == 1)
    resolution = F.when(~open_, F.lit(None)).when(n == 1, "resolved-singleton").when(n > 1, "multiple-targets").when(F.col("_seen"), "unresolvable-target").otherwise("not-seen")
    return rows.select(
        *(c for c in transfers.columns if c not in ("status", "target", "resolver")),
        F.when(single, "resolved").otherwise(F.col("status")).alias("status"),
        F.when(single, F.col("_targets")[0]).otherwise(F.col("target")).alias("target"),
        F.when(single, "flow-analysis").otherwise(F.col("resolver")).alias("resolver"),
        F.when(open_, F.coalesce("_targets", F.array().cast(rows.schema["_targets"].dataType))).alias("possible_targets"),
        resolution.alias("resolution"),
    )


def resolution_summary(resolved: DataFrame) -> DataFrame:
    r = F.col("resolution")
    row = resolved.agg(*(F.count_if(r == k).alias(k.replace("-", "_")) for k in ("resolved-singleton", "multiple-targets", "unresolvable-target", "not-seen")))
    left = F.col("multiple_targets") + F.col("unresolvable_target") + F.col("not_seen")
    return row.withColumn("unresolved_after", left).withColumn("resolution_rate", S.precision(F.col("resolved_singleton"), left))


def call_graph(functions: DataFrame, transfers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(functions with opaque nodes for targets that are none, edges (src, dst, count))."""
    used = transfers.where(F.col("status").isin("resolved", "unmapped") & F.col("target").isNotNull())
    edges = used.groupBy(F.col("source").alias("src"), F.col("target").alias("dst")).agg(F.count("*").alias("count"))
    opaque = edges.select(F.col("dst").alias("address")).distinct().join(functions.select("address"), "address", "left_anti")
    made = opaque.select("address", F.lit(0).cast("long").alias("size"), S.function_id(F.col("address")).alias("name"), F.lit("opaque-target").alias("boundary_source"), F.lit("opaque").alias("kind"))
    return functions.select(*made.columns).unionByName(made), edges


def classify(functions: DataFrame, quality: DataFrame, root: int | None) -> DataFrame:
    """Adds analysis_status, role and colour (of context nodes). quality: address, complete_decode."""
    rows = functions.join(quality.select("address", "complete_decode"), "address", "left")
    is_root = (F.col("address") == root) if root is not None else F.lit(False)
    imported = S.is_import(F.col("name"), F.col("kind"))
    rows = rows.withColumn("analysis_status", S.analysis_status(imported, F.col("kind"), F.col("size"), F.col("complete_decode")))
    rows = rows.withColumn("role", S.grouping_role(F.col("analysis_status"), is_root))
    return rows.withColumn("colour", F.when(F.col("role") == "context-only", S.context_colour(is_root, imported, F.col("name"), F.col("address")))).drop("complete_decode")


def abstentions(classified: DataFrame) -> DataFrame:
    return classified.where("role = 'abstain'").select(S.function_id(F.col("address")).alias("id"), "address", "analysis_status", F.lit("incomplete_body").alias("reason"))


def relation_status(nodes: DataFrame, edges: DataFrame, node: str = "id", role: str = "role") -> DataFrame:
    """Adds relation_status: context, member, or abstain for abstaining nodes and members with no edge to another node."""
    other = edges.where("src <> dst")
    touched = other.select(F.col("src").alias(node)).union(other.select(F.col("dst").alias(node))).distinct().withColumn("_touched", F.lit(True))
    rows = nodes.join(touched, node, "left")
    status = F.when(F.col(role) == "context-only", "context").when(F.col(role) == "abstain", "abstain").when(F.col("_touched"), "member").otherwise("abstain")
    return rows.withColumn("relation_status", status).drop("_touched")


def visible_edges(edges: DataFrame, statuses: DataFrame, node: str = "id") -> DataFrame:
    """Edges whose two ends are members or context."""
    seen = statuses.where(F.col("relation_status").isin("member", "context")).select(node)
    for end in ("src", "dst"):
        edges = edges.join(seen.withColumnRenamed(node, end), end, "left_semi")
    return edges.select("src", "dst", "count")


def choose_root(functions: DataFrame, entry: int) -> Column | int | None:
    """Address of the function at the entry point, or of the one that contains it."""
    spark = functions.sparkSession
    point = spark.createDataFrame([(entry,)], "entry long")
    row = locate(point, functions, "entry", "address", "size", ["address"]).first()
    return None if row is None else row["address"]


def executable(points: DataFrame, segments: DataFrame, point: str) -> DataFrame:
    """Points inside an executable segment. segments: start, size."""
    return locate(points, segments, point, "start", "size", ["start"]).where("start IS NOT NULL").drop("start")
