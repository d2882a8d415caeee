"""Checks that return the rows which break a rule; assert_none() turns any into an error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.functions import scalars as S

#: Names that no label-free table may hold.
FORBIDDEN = ("flirt", "label", "labels", "owner", "canonical_origin", "demangled_name", "ground_truth")


class Invalid(ValueError):
    """A table that breaks a rule."""


def assert_none(broken: DataFrame, what: str) -> None:
    found = broken.limit(1).collect()
    if found:
        raise Invalid(f"{what}: {found[0].asDict()}")


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def candidate_faults(pairs: DataFrame, universe: DataFrame, views: tuple[str, ...], k: int) -> DataFrame:
    """first, second, fault of candidates: order, repetition, unknown ends, scores outside (0, 1], ranks outside 1..k, reasons without a view."""
    n = pairs.groupBy("first", "second").agg(F.count("*").alias("_n"))
    known = universe.select("id").distinct()
    rows = pairs.join(n, ["first", "second"]).join(known.select(F.col("id").alias("first"), F.lit(True).alias("_a")), "first", "left").join(known.select(F.col("id").alias("second"), F.lit(True).alias("_b")), "second", "left")
    found = F.map_values("views")
    bad_view = F.exists(F.map_keys("views"), lambda v: ~v.isin(*views))
    bad_score = F.exists(found, lambda x: (x["score"] <= 0) | (x["score"] > 1) | F.isnan(x["score"]))
    bad_rank = F.exists(found, lambda x: (x["rank"] < 1) | (x["rank"] > k))
    wanted = F.array_sort(F.transform(F.map_keys("views"), lambda v: F.concat(v, F.lit("_top_k"))))
    fault = (
        F.when(F.col("first") >= F.col("second"), "not canonical")
        .when(F.col("_n") > 1, "repeated")
        .when(F.col("_a").isNull() | F.col("_b").isNull(), "outside the universe")
        .when(bad_view, "unknown view")
        .when(bad_score, "score out of range")
        .when(bad_rank, "rank out of range")
        .when(F.array_sort("reasons") != wanted, "reasons differ from views")
    )
    return rows.select("first", "second", fault.alias("fault")).where("fault IS NOT NULL")


def family_faults(families: DataFrame, universe: DataFrame) -> DataFrame:
    """id, fault of a family table (id, family_id, status): members once each, all of the universe, sizes by status, ids by members."""
    n = families.groupBy("id").agg(F.count("*").alias("_n"))
    rows = universe.select("id").distinct().withColumn("_u", F.lit(True)).join(families.join(n, "id"), "id", "full_outer")
    size = families.groupBy("family_id").agg(F.count("*").alias("_size"), S.family_id(F.collect_list("id")).alias("_name"))
    rows = rows.join(size, "family_id", "left")
    fault = (
        F.when(F.col("_u").isNull(), "outside the universe")
        .when(F.col("status").isNull(), "in no family")
        .when(F.col("_n") > 1, "in several families")
        .when(~F.col("status").isin("accepted", "provisional", "unresolved", "abstain"), "unknown status")
        .when((F.col("status") == "accepted") != (F.col("_size") > 1), "size against status")
        .when(F.col("_name") != F.col("family_id"), "family id against members")
    )
    return rows.select("id", fault.alias("fault")).where("fault IS NOT NULL")


def label_faults(labels: DataFrame) -> DataFrame:
    """member, fault of a label table: repeated evidence, bucket against evidence, seedable against evidence."""
    from kinweave.operators.labels import BUCKETS, SEED

    n = labels.groupBy("evidence", "address").agg(F.count("*").alias("_n"))
    bucket = F.lit(None).cast("string")
    for evidence, name in BUCKETS.items():
        bucket = F.when(F.col("evidence") == evidence, name).otherwise(bucket)
    fault = F.when(F.col("_n") > 1, "repeated").when(bucket.isNull(), "unknown evidence").when((F.col("bucket") != bucket) & (F.col("bucket") != "unmatched_addresses"), "bucket against evidence").when(F.col("seedable") != (F.col("evidence") == SEED), "seedable against evidence")
    return labels.join(n, ["evidence", "address"]).select("member", fault.alias("fault")).where("fault IS NOT NULL")


def differences(given: DataFrame, derived: DataFrame) -> DataFrame:
    """Rows that one table has more often than the other, with the side."""
    a, b = given, derived.select(*given.columns)
    return a.exceptAll(b).withColumn("_side", F.lit("given")).unionByName(b.exceptAll(a).withColumn("_side", F.lit("derived")))


def partition_faults(given: DataFrame, strict: DataFrame) -> DataFrame:
    """id, fault: members of two partitions (family_id, id) that only one has, or that repeat."""
    a = given.groupBy("id").agg(F.count("*").alias("_a"))
    b = strict.groupBy("id").agg(F.count("*").alias("_b"))
    fault = F.when(F.col("_a").isNull(), "missing").when(F.col("_b").isNull(), "added").when(F.col("_a") > 1, "repeated")
    return a.join(b, "id", "full_outer").select("id", fault.alias("fault")).where("fault IS NOT NULL")


def decision_faults(decisions: DataFrame) -> DataFrame:
    n = decisions.groupBy("first", "second").agg(F.count("*").alias("_n"))
    fault = F.when(F.col("first") >= F.col("second"), "not canonical").when(F.col("_n") > 1, "repeated").when(~F.col("decision").isin("match", "reject", "unknown", "abstain"), "unknown decision").when(~F.col("source").isin("candidate", "on-demand"), "unknown source")
    return decisions.join(n, ["first", "second"]).select("first", "second", fault.alias("fault")).where("fault IS NOT NULL")


def catalog_faults(catalog: DataFrame, aliases: DataFrame) -> DataFrame:
    """member, fault of a catalog (origin, member, owner) and its aliases (member, origins)."""
    n = catalog.groupBy("member").agg(F.count("*").alias("_n"), F.min("origin").alias("_o"))
    rows = n.join(aliases.select("member", "origins"), "member", "full_outer")
    fault = F.when(F.col("_n").isNull(), "alias of no member").when(F.col("_n") > 1, "repeated").when(F.col("origins").isNotNull() & ((F.size("origins") < 2) | ~F.array_contains("origins", F.col("_o"))), "alias against origin")
    return rows.select("member", fault.alias("fault")).where("fault IS NOT NULL")


def forbidden_columns(schema: T.StructType, forbidden: tuple[str, ...] = FORBIDDEN, where: str = "") -> list[str]:
    """Paths of forbidden names anywhere in a schema."""
    out = []
    for f in schema.fields:
        path = f"{where}.{f.name}" if where else f.name
        if f.name.lower() in forbidden:
            out.append(path)
        kind = f.dataType
        while isinstance(kind, (T.ArrayType, T.MapType)):
            kind = kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType
        if isinstance(kind, T.StructType):
            out += forbidden_columns(kind, forbidden, path)
    return out


def assert_label_free(df: DataFrame, what: str) -> DataFrame:
    found = forbidden_columns(df.schema)
    if found:
        raise Invalid(f"{what} holds {', '.join(found)}")
    return df


def assert_agreement(what: str, left: dict, right: dict, keys: tuple[str, ...]) -> None:
    """Two manifests must say the same of each key."""
    odd = [k for k in keys if left.get(k) != right.get(k)]
    if odd:
        raise Invalid(f"{what} disagree on {', '.join(odd)}")
