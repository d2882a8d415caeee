"""What a stage may hand on: columns by allow-list, so that no label gets in by being forgotten.

Tables stay tables; what is kept in a run's manifest is their digests and counts.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions import scalars as S
from kinweave.operators import validate
from kinweave.sources import artifacts

#: The columns that each stage shows of functions.
SHOWN = {
    "discovery": ("id", "address", "kind", "size", "boundary_source", "external_identity"),
    "universe": ("id", "analysis_status", "grouping_role", "quality"),
    "relation": ("id", "relation_status"),
    "core": ("id", "address", "kind", "size", "boundary_source", "analysis_status", "grouping_role", "relation_status", "quality", "external_identity"),
}

#: A digest as manifests write it.
_SHA256 = re.compile("[0-9a-f]{64}")


def project(functions: DataFrame, stage: str) -> DataFrame:
    """The columns that a stage may show, in their fixed order; those that functions lack are left out."""
    return functions.select(*(c for c in SHOWN[stage] if c in functions.columns))


def stage_tables(functions: DataFrame, transfers: DataFrame, bodies: DataFrame, edges: DataFrame, rounds: DataFrame, anchors: DataFrame, abstentions: DataFrame) -> dict[str, dict[str, DataFrame]]:
    """The tables of the four stages that know no label; a forbidden column anywhere is an error."""
    out = {
        "discovery": {"functions": project(functions, "discovery"), "transfers": transfers},
        "body": {"bodies": bodies},
        "universe": {"functions": project(functions, "universe"), "abstentions": abstentions},
        "relation": {"functions": project(functions, "relation"), "rounds": rounds, "anchors": anchors, "edges": edges},
    }
    for stage, parts in out.items():
        for name, table in parts.items():
            validate.assert_label_free(table, f"{stage}.{name}")
    return out


def core_digest(subject_sha256: str, root: str | None, functions: DataFrame, edges: DataFrame, clusters: DataFrame, abstentions: DataFrame) -> str:
    """Digest of what grouping depends on and labels can't change."""
    parts = {"functions": project(functions, "core"), "edges": edges, "clusters": clusters, "abstentions": abstentions}
    return artifacts.digest({"subject": subject_sha256, "root": root, **{k: artifacts.table_digest(t) for k, t in parts.items()}})


def opaque_alias(bodies: DataFrame) -> DataFrame:
    """bodies with opaque_indirect_jumps from opaque_indirect_jump_count; an error where they differ or one is negative."""
    one = F.coalesce(F.col("opaque_indirect_jump_count"), F.lit(0)) if "opaque_indirect_jump_count" in bodies.columns else F.lit(0)
    other = F.col("opaque_indirect_jumps") if "opaque_indirect_jumps" in bodies.columns else F.lit(None).cast("long")
    broken = (one < 0) | F.coalesce(other < 0, F.lit(False)) | F.coalesce(other != one, F.lit(False))
    value = F.when(broken, F.raise_error(F.concat(F.col("id"), F.lit(": conflicting or negative opaque jump counts")))).otherwise(one)
    return bodies.withColumn("opaque_indirect_jumps", value.cast("long"))


def raw_graph_view(transfers: DataFrame) -> DataFrame:
    """Transfers by address in place of ids: source, callsite, target, targets of the flow analysis as hexadecimal addresses; nothing is filtered."""
    targets = F.transform("angr_targets", lambda t: S.hex_address(S.address_of_id(t)))
    return transfers.select(
        F.col("source_address").alias("source"), "callsite", F.col("target_address").alias("target"), "status", "kind", "operand_kind", "resolver", "confidence", targets.alias("angr_targets"), F.lit(None).cast("string").alias("filter_reason")
    )


def subject(binary_sha256: str) -> dict[str, str]:
    """Placeholders for a subject whose compilation is unknown: only its digest is true of it."""
    return {"case": f"subject-{binary_sha256[:16]}", "build": "UNKNOWN", "profile": "plain", "scope": "members"}


def relation_summary(groups: DataFrame) -> dict[str, int]:
    """What identifies a relation without holding it."""
    row = groups.agg(F.coalesce(F.max("round"), F.lit(0)).alias("final_round"), F.count_distinct("round").alias("rounds")).first()
    last = groups.where(F.col("round") == row["final_round"]).agg(F.count_distinct("cluster").alias("n")).first()["n"]
    return {"rounds": row["rounds"], "final_round": row["final_round"], "final_group_count": last, "prior_round_count": max(row["rounds"] - 1, 0)}


def queue_manifest(pairs: DataFrame, bodies: DataFrame, k: int, views: tuple[str, ...], who: dict[str, str], provenance: dict, relation: dict | None = None, minimum_views: int | None = None, source: str | None = None, sha256: str | None = None) -> dict:
    """The manifest of a candidate queue: settings, counts and digests. A queue derived from another names it and its rule.

    sha256: the digest of pairs, where it is known.
    """
    validate.assert_none(validate.duplicates(pairs, "first", "second"), "repeated pair")
    n = bodies.agg(F.count("*").alias("n"), F.count_if("complete_decode").alias("c")).first()
    out = {
        "artifact": "candidate-queue", **who, "config": {"top_k": k, "view_top_k": dict.fromkeys(views, k), "views": list(views)}, "provenance": dict(provenance),
        "universe": {"target_count": n["n"], "complete_body_count": n["c"]}, "pair_count": pairs.count(), "pairs_sha256": sha256 or artifacts.table_digest(pairs),
    }
    if relation is not None:
        out["relation"] = relation
    if minimum_views is not None:
        out["provenance"]["derivation"] = {"kind": "minimum-view-consensus", "minimum_view_count": minimum_views, "source_sha256": source}
    return out


def check_queue(families: dict, queue: dict, minimum_views: int) -> None:
    """A queue that a later stage reads must be of the same subject, universe and evidence, and derived by the rule that the stage wants."""
    got = queue["provenance"].get("derivation", {})
    if got.get("kind") != "minimum-view-consensus" or got.get("minimum_view_count") != minimum_views:
        raise validate.Invalid(f"a queue that {minimum_views} views agree on is wanted")
    validate.assert_agreement("families and queue", families, queue, ("case", "build", "profile", "scope", "universe"))
    validate.assert_agreement("families' and queue's provenance", families["provenance"], queue["provenance"], ("subject_sha256", "body_sha256"))


def check_audit(audit: Mapping[str, Any], run: Mapping[str, Any], truth: Mapping[str, Any], truth_sha256: str) -> None:
    """A linkage audit must have been made from this truth and for this run's subject.

    The truth's digest and case, build and profile must be in the audit. Digests of binaries need not; one of the binary
    with symbols counts for nothing if the truth has none. What the run or the truth doesn't record isn't compared.
    """
    made_from, known = audit.get("provenance") or {}, truth.get("provenance") or {}
    digests = {
        "ground_truth_sha256": (truth_sha256,),
        "stripped_sha256": ((run.get("binary") or {}).get("sha256"), known.get("stripped_sha256")),
        "non_stripped_sha256": (known.get("non_stripped_sha256"),),
    }
    names = {k: (truth.get(k), run.get(k)) for k in ("case", "build", "profile")}
    own = {**{k: made_from.get(k) for k in digests}, **{k: audit.get(k) for k in names}}
    absent = [k for k in ("ground_truth_sha256", *names) if own[k] is None]
    if absent:
        raise validate.Invalid(f"the audit doesn't record {', '.join(absent)}")
    said = {k: v for k, v in own.items() if v is not None}
    if odd := [k for k in digests if k in said and not _SHA256.fullmatch(str(said[k]))] or [k for k in ("truth",) if not _SHA256.fullmatch(truth_sha256)]:
        raise validate.Invalid(f"not a digest: {', '.join(odd)}")
    if "non_stripped_sha256" in said and known.get("non_stripped_sha256") is None:
        raise validate.Invalid("the truth doesn't record non_stripped_sha256, the audit does")
    if odd := [k for k, others in (digests | names).items() if k in said and any(o is not None and o != said[k] for o in others)]:
        raise validate.Invalid(f"the audit is of another {', '.join(odd)}")


def outside_groups(groups: DataFrame, abstained: DataFrame, universe: DataFrame) -> DataFrame:
    """group, id of another engine's result; an error if its members and abstentions (id) aren't the universe (id)."""
    seen = groups.select("id").union(abstained.select("id")).distinct().withColumn("_s", F.lit(True))
    both = seen.join(universe.select("id").distinct().withColumn("_u", F.lit(True)), "id", "full_outer")
    validate.assert_none(both.where("_s IS NULL OR _u IS NULL").select("id", F.when(F.col("_u").isNull(), "not in the universe").otherwise("not in the result").alias("fault")), "another engine's groups")
    return groups.select("group", "id")


def partition_rows(given) -> list[tuple[str, str]]:
    """(family_id, id) of a partition given as {family: members}, [{"id", "members"}] or lists of members; every family has two or more, no member two families."""
    if hasattr(given, "items"):
        parts = list(given.items())
    else:
        parts = [(x["id"], x["members"]) if hasattr(x, "keys") else (min(x, default=""), x) for x in given]
    rows, seen = [], set()
    for name, members in parts:
        if len(set(members)) != len(members) or len(members) < 2:
            raise validate.Invalid(f"{name}: two or more different members are wanted")
        if seen & set(members):
            raise validate.Invalid(f"{name}: a member of another family")
        seen |= set(members)
        rows += [(name, m) for m in sorted(members)]
    if len({n for n, _ in parts}) < len(parts):
        raise validate.Invalid("families of one name")
    return sorted(rows)
