"""Slots, templates, variation axes, and rescue of split families.

Everything is long tables keyed by component (or family), slot and member; partitions are compared by what
they separate, never by names of members.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinweave.functions import scalars as S
from kinweave.operators import graph


def transfer_state(n_targets: Column, status: Column, target: Column, present: Column) -> Column:
    """State of a call slot: missing without a transfer, ambiguous with several targets, filtered, resolved, unresolved."""
    return F.when(~present, "missing").when(n_targets > 1, "ambiguous").when(status == "filtered", "filtered").when((status == "resolved") & target.isNotNull(), "resolved").otherwise("unresolved")


def unique_sites(transfers: DataFrame) -> DataFrame:
    """The transfers, or an error if a (source, callsite) repeats."""
    n = F.count("*").over(Window.partitionBy("source", "callsite"))
    return transfers.withColumn("_n", n).where(F.when(F.col("_n") > 1, F.raise_error(F.lit("duplicate callsite"))).otherwise(F.lit(True))).drop("_n")


def slots(instructions: DataFrame, functions: DataFrame, transfers: DataFrame) -> DataFrame:
    """id, offset, index, kind, value, state of all slots of all functions.

    Calls and jumps out of a function look up the transfer at their address (index 0); data references, then
    constants, come from the instruction itself (index 1 on). functions: id, address; transfers: source (an
    address), callsite, kind, status, target, n_targets.
    """
    t = transfers.select(F.col("source").alias("address"), "callsite", F.col("kind").alias("_kind"), F.col("status").alias("_status"), F.col("target").cast("string").alias("_target"), F.coalesce("n_targets", F.lit(0)).alias("_n"), F.lit(True).alias("_present"))
    rows = instructions.join(functions.select("id", "address"), "id").withColumn("callsite", F.col("address") + F.col("offset"))
    aimed = rows.where(F.col("control_flow").isin("call", "external_jump", "indirect_jump")).join(t, ["address", "callsite"], "left")
    aimed = aimed.where("control_flow <> 'indirect_jump' OR _kind = 'tail-call'").withColumn("_present", F.coalesce("_present", F.lit(False)))
    state = transfer_state(F.col("_n"), F.col("_status"), F.col("_target"), F.col("_present"))
    calls = aimed.select("id", "offset", F.lit(0).alias("index"), F.when(F.col("control_flow") == "call", "CALL_TARGET").otherwise("TAIL_CALL_TARGET").alias("kind"), F.when(state.isin("filtered", "resolved"), F.col("_target")).alias("value"), state.alias("state"))
    data = F.transform(F.filter("slots", lambda s: s["kind"] == "data"), lambda s: F.struct(F.lit("DATA_REFERENCE").alias("kind"), s["value"].alias("value")))
    numbers = F.transform("constants", lambda c: F.struct(F.lit("IMMEDIATE_CONSTANT").alias("kind"), c.cast("string").alias("value")))
    own = instructions.select("id", "offset", F.posexplode(F.concat(data, numbers)).alias("k", "s"))
    own = own.select("id", "offset", (F.col("k") + 1).alias("index"), F.col("s.kind").alias("kind"), F.col("s.value").alias("value"), F.when(F.col("s.value").isNull(), "missing").otherwise("resolved").alias("state"))
    return calls.unionByName(own)


def medoids(scores: DataFrame) -> DataFrame:
    """family, medoid, mean_similarity: the member most similar to the others, of equals the least id.

    scores: family, first, second, score of all pairs of each family.
    """
    both = scores.select("family", F.col("first").alias("id"), "score").unionByName(scores.select("family", F.col("second").alias("id"), "score"))
    means = both.groupBy("family", "id").agg((F.sum("score") / F.count("*")).alias("mean"))
    best = F.min(F.struct((-F.col("mean")).alias("neg"), "id"))
    return means.groupBy("family").agg(best.alias("_b")).select("family", F.col("_b.id").alias("medoid"), (-F.col("_b.neg")).alias("mean_similarity"))


def template(members: DataFrame, medoid: DataFrame, observed: DataFrame, aligned: DataFrame) -> DataFrame:
    """family, offset, index, kind, id, value, state: each slot of the medoid as each member fills it.

    members: family, id. aligned: family, id, medoid_offset, member_offset of instruction pairs. A member without a slot
    at the aligned place is missing there; the medoid stands for itself.
    """
    m = members.join(medoid.select("family", "medoid"), "family")
    anchors = observed.join(medoid.select("family", F.col("medoid").alias("id")), "id").select("family", "offset", "index", "kind", F.col("value").alias("_v"), F.col("state").alias("_s"))
    rows = anchors.join(m, "family")
    rows = rows.join(aligned.select("family", "id", F.col("medoid_offset").alias("offset"), "member_offset"), ["family", "id", "offset"], "left")
    theirs = observed.select("id", F.col("offset").alias("member_offset"), "index", "kind", "value", "state")
    rows = rows.join(theirs, ["id", "member_offset", "index", "kind"], "left")
    self_ = F.col("id") == F.col("medoid")
    return rows.select("family", "offset", "index", "kind", "id", F.when(self_, F.col("_v")).otherwise(F.col("value")).alias("value"), F.when(self_, F.col("_s")).otherwise(F.coalesce("state", F.lit("missing"))).alias("state"))


def block_roles(members: DataFrame, medoid: DataFrame, blocks: DataFrame, matched: DataFrame) -> DataFrame:
    """family, label, role: common if every member has a block aligned to the medoid's, else optional. matched: family, id, label."""
    n = members.groupBy("family").agg(F.count("*").alias("_n"))
    own = blocks.select("id", "label").join(medoid.select("family", F.col("medoid").alias("id")), "id").select("family", "label")
    hit = matched.groupBy("family", "label").agg(F.count_distinct("id").alias("_hit"))
    rows = own.join(hit, ["family", "label"], "left").join(n, "family")
    return rows.select("family", "label", F.when(F.coalesce("_hit", F.lit(0)) + 1 == F.col("_n"), "common").otherwise("optional").alias("role"))


def orphan_blocks(members: DataFrame, medoid: DataFrame, blocks: DataFrame, paired: DataFrame) -> DataFrame:
    """family, id, label of members' blocks that no block of the medoid is aligned to. paired: family, id, label of the member."""
    others = members.join(medoid.select("family", "medoid"), "family").where("id <> medoid").select("family", "id")
    return others.join(blocks.select("id", "label"), "id").join(paired, ["family", "id", "label"], "left_anti")


def axes(filled: DataFrame) -> DataFrame:
    """family, axis, id, label: groups of slots that separate the members alike.

    A slot counts if every member resolved it and not all alike. Members' labels are numbered by least member, so that
    equal partitions are equal rows; axes are numbered by their first slot.
    """
    slot = ["family", "offset", "index", "kind"]
    w = Window.partitionBy(*slot)
    whole = filled.withColumn("_ok", F.min((F.col("state") == "resolved").cast("int")).over(w) == 1)
    whole = whole.where("_ok").withColumn("_first", F.min("id").over(Window.partitionBy(*slot, "value")))
    varying = whole.withColumn("_lo", F.min("_first").over(w)).withColumn("_hi", F.max("_first").over(w)).where("_lo <> _hi")
    shape = varying.groupBy(*slot).agg(F.array_sort(F.collect_list(F.struct("id", F.col("_first").alias("group")))).alias("shape"))
    merged = shape.groupBy("family", "shape").agg(F.min(F.struct("offset", "index")).alias("_at"), F.count("*").alias("n_slots"))
    named = merged.withColumn("axis", F.row_number().over(Window.partitionBy("family").orderBy("_at")))
    rows = named.select("family", "axis", "n_slots", F.explode("shape").alias("s")).select("family", "axis", "n_slots", "s.id", "s.group")
    return rows.withColumn("label", F.dense_rank().over(Window.partitionBy("family", "axis").orderBy("group")) - 1).select("family", "axis", "id", "label", "n_slots")


def coverage(found: DataFrame) -> DataFrame:
    """family, first, second, expected, observed, complete, bijective of each two axes of a family: do they span all combinations, and each once?"""
    a = found.select("family", "id", F.col("axis").alias("first"), F.col("label").alias("_l1"))
    b = found.select("family", "id", F.col("axis").alias("second"), F.col("label").alias("_l2"))
    cells = a.join(b, ["family", "id"]).where("first < second").groupBy("family", "first", "second", "_l1", "_l2").agg(F.count("*").alias("c"))
    rows = cells.groupBy("family", "first", "second").agg((F.count_distinct("_l1") * F.count_distinct("_l2")).alias("expected"), F.count("*").alias("observed"), F.max("c").alias("_most"))
    full = F.col("expected") == F.col("observed")
    return rows.select("family", "first", "second", "expected", "observed", full.alias("complete"), (full & (F.col("_most") == 1)).alias("bijective"))


def refinements(found: DataFrame) -> DataFrame:
    """family, fine, coarse: each group of fine lies in one group of coarse."""
    a = found.select("family", "id", F.col("axis").alias("fine"), F.col("label").alias("_f"))
    b = found.select("family", "id", F.col("axis").alias("coarse"), F.col("label").alias("_c"))
    groups = a.join(b, ["family", "id"]).where("fine <> coarse").groupBy("family", "fine", "coarse", "_f").agg(F.count_distinct("_c").alias("n"))
    return groups.groupBy("family", "fine", "coarse").agg(F.max("n").alias("n")).where("n = 1").select("family", "fine", "coarse")


def maximal(found: DataFrame, finer: DataFrame) -> DataFrame:
    """family, axis of the axes that no other refines."""
    return found.select("family", "axis").distinct().join(finer.select("family", F.col("coarse").alias("axis")).distinct(), ["family", "axis"], "left_anti")


def basis(found: DataFrame, covered: DataFrame, finer: DataFrame, top: DataFrame) -> DataFrame:
    """family, first, second, status: the bijective pair of maximal axes that every other axis coarsens, if there is one.

    status: unique, ambiguous, no_pair_explains_every_axis or none.
    """
    t = top.select("family", "axis")
    pairs = covered.join(t.withColumnRenamed("axis", "first"), ["family", "first"], "left_semi").join(t.withColumnRenamed("axis", "second"), ["family", "second"], "left_semi")
    good = pairs.where("bijective").select("family", "first", "second")
    every = found.select("family", "axis").distinct()
    others = good.join(every, "family").where("axis <> first AND axis <> second")
    cov1 = finer.select("family", F.col("fine").alias("first"), F.col("coarse").alias("axis"), F.lit(True).alias("_a"))
    cov2 = finer.select("family", F.col("fine").alias("second"), F.col("coarse").alias("axis"), F.lit(True).alias("_b"))
    open_ = others.join(cov1, ["family", "first", "axis"], "left").join(cov2, ["family", "second", "axis"], "left").where("_a IS NULL AND _b IS NULL").select("family", "first", "second").distinct()
    fit = good.join(open_, ["family", "first", "second"], "left_anti").groupBy("family").agg(F.count("*").alias("n"), F.min(F.struct("first", "second")).alias("p"))
    any_ = good.select("family").distinct().withColumn("_any", F.lit(True))
    rows = found.select("family").distinct().join(fit, "family", "left").join(any_, "family", "left")
    n = F.coalesce("n", F.lit(0))
    status = F.when(n == 1, "unique").when(n > 1, "ambiguous").when(F.col("_any"), "no_pair_explains_every_axis").otherwise("none")
    return rows.select("family", F.when(n == 1, F.col("p.first")).alias("first"), F.when(n == 1, F.col("p.second")).alias("second"), status.alias("status"))


def internal_support(found: DataFrame, fragments: DataFrame) -> DataFrame:
    """family, axis, supported: does the axis vary inside some fragment? fragments: id, fragment."""
    inside = found.join(fragments.select("id", "fragment"), "id").groupBy("family", "axis", "fragment").agg(F.count_distinct("label").alias("n"))
    return inside.groupBy("family", "axis").agg((F.max("n") >= 2).alias("supported"))


def axis_report(filled: DataFrame) -> DataFrame:
    """family, n_slots, observed_by_all, varying of each family, and how many slots of each kind."""
    slot = ["family", "offset", "index", "kind"]
    per = filled.groupBy(*slot).agg(F.min((F.col("state") == "resolved").cast("int")).alias("_ok"), F.count_distinct(F.coalesce("value", F.lit(""))).alias("_n"))
    return per.groupBy("family").agg(F.count("*").alias("n_slots"), F.sum("_ok").alias("observed_by_all"), F.count_if((F.col("_ok") == 1) & (F.col("_n") > 1)).alias("varying"), *(F.count_if(F.col("kind") == k).alias(k.lower()) for k in ("CALL_TARGET", "TAIL_CALL_TARGET", "DATA_REFERENCE", "IMMEDIATE_CONSTANT")))


def excluded_slots(filled: DataFrame) -> DataFrame:
    """Slots that make no axis, with the reason and the states seen."""
    slot = ["family", "offset", "index", "kind"]
    per = filled.groupBy(*slot).agg(F.min((F.col("state") == "resolved").cast("int")).alias("_ok"), F.count_distinct("value").alias("_n"), F.array_sort(F.collect_set("state")).alias("states"))
    return per.where("NOT (_ok = 1 AND _n > 1)").select(*slot, F.when(F.col("_ok") == 1, "invariant").otherwise("not_resolved_for_every_member").alias("reason"), "states")


# rescue


def fragments_of(families: DataFrame) -> DataFrame:
    """id, fragment of accepted families (id, family_id, status)."""
    return families.where("status = 'accepted'").select("id", F.col("family_id").alias("fragment"))


def rescue_components(fragments: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fragment, component of fragments that candidate pairs join; component, first, second of bridges).

    pairs: first, second, same_prior_colour. Components are of fragments, never of functions. A bridge is a crossing
    pair whose ends once had the same colour.
    """
    f = fragments.select("id", "fragment")
    crossing = pairs.join(f.select(F.col("id").alias("first"), F.col("fragment").alias("_a")), "first").join(f.select(F.col("id").alias("second"), F.col("fragment").alias("_b")), "second").where("_a <> _b")
    joined = crossing.select(F.least("_a", "_b").alias("first"), F.greatest("_a", "_b").alias("second")).distinct()
    comp = graph.components(f.select(F.col("fragment").alias("id")).distinct(), joined).select(F.col("id").alias("fragment"), "component")
    n = F.count("*").over(Window.partitionBy("component"))
    comp = comp.withColumn("_n", n).where("_n > 1").drop("_n")
    bridges = crossing.where("coalesce(same_prior_colour, false)").join(comp.withColumnRenamed("fragment", "_a"), "_a").select("component", F.least("first", "second").alias("first"), F.greatest("first", "second").alias("second")).distinct()
    return comp, bridges


def reserve(members: DataFrame, lengths: DataFrame) -> DataFrame:
    """component, n_members, comparisons, cells: all pairs of a component and the worst medoid against the rest."""
    rows = members.join(lengths.select("id", F.col("n").cast("long").alias("n")), "id")
    per = rows.groupBy("component").agg(F.count("*").alias("n_members"), F.sum("n").alias("_s"), F.sum(F.col("n") * F.col("n")).alias("_q"))
    worst = rows.join(per, "component").groupBy("component").agg(F.max(F.col("n") * (F.col("_s") - F.col("n"))).alias("_worst"))
    return per.join(worst, "component").select("component", "n_members", F.expr("n_members * (n_members - 1) div 2 + n_members - 1").alias("comparisons"), F.expr("(_s * _s - _q) div 2 + _worst").alias("cells"))


def rescue_reasons(components: DataFrame, bridges: DataFrame, found: DataFrame, covered: DataFrame, top: DataFrame, chosen: DataFrame, support: DataFrame) -> DataFrame:
    """component, status, reason: accepted, or rejected by the first condition that fails.

    components: component (one row each); found ... support: axes and what was derived from them, by family = component.
    """
    t = top.select("family", "axis")
    n_top = t.groupBy("family").agg(F.count("*").alias("_n_top"))
    pairs = covered.join(t.withColumnRenamed("axis", "first"), ["family", "first"], "left_semi").join(t.withColumnRenamed("axis", "second"), ["family", "second"], "left_semi")
    state = pairs.groupBy("family").agg(F.max("complete").alias("_complete"), F.max("bijective").alias("_bijective"))
    own = chosen.where("status = 'unique'").select("family", F.explode(F.array("first", "second")).alias("axis")).join(support, ["family", "axis"], "left")
    held = own.groupBy("family").agg(F.min(F.coalesce("supported", F.lit(False))).alias("_supported"))
    bridge = bridges.select(F.col("component").alias("family")).distinct().withColumn("_bridge", F.lit(True))
    rows = components.select(F.col("component").alias("family"))
    for other in (bridge, n_top, state, chosen.select("family", "status"), held):
        rows = rows.join(other, "family", "left")
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    reason = (
        F.when(no("_bridge"), "no_relation_bridge")
        .when(F.coalesce("_n_top", F.lit(0)) < 2, "too_few_independent_axes")
        .when((F.coalesce("status", F.lit("none")) != "unique") & no("_complete"), "basis_not_complete")
        .when((F.coalesce("status", F.lit("none")) != "unique") & no("_bijective"), "basis_not_bijective")
        .when(F.coalesce("status", F.lit("none")) != "unique", "basis_not_unique")
        .when(no("_supported"), "axis_without_internal_fragment_support")
    )
    return rows.select(F.col("family").alias("component"), F.when(reason.isNull(), "accepted").otherwise("rejected").alias("status"), reason.alias("reason"))


def final_partition(fragments: DataFrame, comp: DataFrame, verdicts: DataFrame) -> DataFrame:
    """family_id, id, origin: accepted components as one family (ids of their fragments joined by '+'), all others strict."""
    good = comp.join(verdicts.where("status = 'accepted'").select("component"), "component", "left_semi")
    names = good.groupBy("component").agg(F.array_join(F.array_sort(F.collect_list("fragment")), "+").alias("family_id"))
    renamed = good.join(names, "component").select("fragment", "family_id")
    rows = fragments.join(renamed, "fragment", "left")
    return rows.select(F.coalesce("family_id", "fragment").alias("family_id"), "id", F.when(F.col("family_id").isNull(), "strict").otherwise("rescued").alias("origin"))


def rescue(components: DataFrame, costs: DataFrame, verdicts: DataFrame, max_members: int = 64, max_comparisons: int = 4096, max_cells: int = 500_000_000) -> DataFrame:
    """component, status, reason with whole components admitted in order until the budget ends; the others are budget_blocked."""
    from kinweave.operators import grouping

    small = costs.where(F.col("n_members") <= max_members)
    admitted = grouping.admit(small, S.PairPolicy(max_comparisons=max_comparisons, max_cells=max_cells)).select("component", "selected")
    rows = components.select("component").join(costs.select("component", "n_members"), "component", "left").join(admitted, "component", "left").join(verdicts, "component", "left")
    blocked = F.when(F.col("n_members") > max_members, "too_many_members").when(~F.coalesce("selected", F.lit(False)), "over_budget")
    return rows.select("component", F.when(blocked.isNotNull(), "budget_blocked").otherwise(F.col("status")).alias("status"), F.coalesce(blocked, "reason").alias("reason"))
