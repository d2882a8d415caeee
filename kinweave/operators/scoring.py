"""Scores against a known truth. Pairs are counted from group sizes, never made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions import scalars as S
from kinweave.sources import tables

#: Classes of ids in a tile of count_pairs().
TILE = 4096

NEUTRAL = ("duplicate", "ambiguous", "unresolved")


def discovery(known: DataFrame, universe: DataFrame, bodies: DataFrame) -> DataFrame:
    """One row: how many known functions (id) were found (id, analysis_status), missed, decoded (id, complete_decode, failure_reason)."""
    rows = known.select("id").distinct().join(universe.select("id", F.lit(True).alias("_found")).distinct(), "id", "left").join(bodies.select("id", "complete_decode", "failure_reason"), "id", "left")
    found, complete = F.coalesce("_found", F.lit(False)), F.coalesce("complete_decode", F.lit(False))
    failed = found & ~complete & F.coalesce(F.col("failure_reason").isin("decode_gap", "zero_instruction_decode"), F.lit(False))
    n = F.count("*")
    row = rows.agg(n.alias("known_count"), F.count_if(found).alias("discovered_count"), F.count_if(~found).alias("missed_count"), F.count_if(failed).alias("failed_decode_count"), F.count_if(found & complete).alias("complete_body_count"), F.when(n > 0, F.round(F.count_if(found & complete) / n, 4)).alias("complete_body_coverage"))
    status = universe.agg(F.count_if(F.col("analysis_status") == "address-only").alias("address_only_count"), F.count_if(F.col("analysis_status") == "incomplete").alias("incomplete_count"))
    return row.crossJoin(status)


def _pairs_of(n: str):
    return F.expr(f"{n} * ({n} - 1) div 2")


def _with_neutral_members(rows: DataFrame, linkage: DataFrame, universe: DataFrame) -> DataFrame:
    """One row: how many pairs have an end that can't be judged, in all, by label, and inside groups, origins and both.

    In a cell of n members, m of which can be judged, these are n (n - 1) / 2 - m (m - 1) / 2 pairs, so none is made.
    """
    ids = linkage.join(universe.select("id").distinct(), "id", "left_semi").select("id")
    held = ids.join(neutral_members(linkage, universe), "id", "left").join(rows.select("id", "group", "origin"), "id", "left")

    def pairs(name: str, *keys: str) -> DataFrame:
        n = held.dropna(subset=list(keys)) if keys else held
        n = n.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("label") == "ambiguous", F.lit(True))).alias("r"), F.count_if(F.col("label").isNull()).alias("m"))
        gone = lambda a, b, to: F.coalesce(F.sum(_pairs_of(a) - _pairs_of(b)), F.lit(0)).alias(to)
        return n.agg(gone("n", "m", name), *([] if keys else [gone("n", "r", "_munresolved"), gone("r", "m", "_mambiguous")]))

    return pairs("_mall").crossJoin(pairs("_mtp", "group", "origin")).crossJoin(pairs("_mpred", "group")).crossJoin(pairs("_mtrue", "origin"))


def pair_confusion(predicted: DataFrame, truth: DataFrame, universe: DataFrame, neutral: DataFrame | None = None, linkage: DataFrame | None = None) -> DataFrame:
    """One row: true and false positives and negatives over pairs, precision, recall, F1, of disjoint groups.

    predicted: group, id; truth: origin, id (one origin an id); universe: id; neutral: first, second, label. Pairs inside a
    group are n (n - 1) / 2; pairs right in both are the same sum over (group, origin); neutral pairs are looked up and
    taken out of each count. So the work grows with members, not with pairs. linkage (id, identities, origins) in place of
    neutral gives the counts of all_neutral_pairs() without making the pairs of ids that can't be judged.
    """
    if linkage is not None:
        if neutral is not None:
            raise ValueError("neutral pairs or a linkage, not both")
        neutral = neutral_pairs(linkage, universe)
    scored = truth.select("origin", "id").join(universe.select("id").distinct(), "id", "left_semi")
    rows = scored.join(predicted.select("group", "id"), "id", "left")
    both = rows.where("group IS NOT NULL").groupBy("group", "origin").agg(F.count("*").alias("n"))
    total = lambda d, name: d.agg(F.coalesce(F.sum(_pairs_of("n")), F.lit(0)).alias(name))
    row = total(both, "_tp").crossJoin(total(rows.where("group IS NOT NULL").groupBy("group").agg(F.count("*").alias("n")), "_pred")).crossJoin(total(rows.groupBy("origin").agg(F.count("*").alias("n")), "_true"))
    row = row.crossJoin(rows.agg(F.count("*").alias("scored_member_count")))
    if neutral is None:
        row = row.withColumns({k: F.lit(0) for k in ("_ntp", "_npred", "_ntrue", "neutral_pair_total", *(f"{x}_neutral" for x in NEUTRAL))})
    else:
        kept = neutral.where(F.col("label").isin(*NEUTRAL)).select(F.least("first", "second").alias("first"), F.greatest("first", "second").alias("second"), "label").distinct()
        ends = kept.join(rows.select(F.col("id").alias("first"), F.col("group").alias("_g1"), F.col("origin").alias("_o1")), "first", "left").join(rows.select(F.col("id").alias("second"), F.col("group").alias("_g2"), F.col("origin").alias("_o2")), "second", "left")
        g, o = F.coalesce(F.col("_g1") == F.col("_g2"), F.lit(False)), F.coalesce(F.col("_o1") == F.col("_o2"), F.lit(False))
        row = row.crossJoin(ends.agg(F.count_if(g & o).alias("_ntp"), F.count_if(g).alias("_npred"), F.count_if(o).alias("_ntrue"), F.count("*").alias("neutral_pair_total"), *(F.count_if(F.col("label") == x).alias(f"{x}_neutral") for x in NEUTRAL)))
    if linkage is not None:
        row = row.crossJoin(_with_neutral_members(rows, linkage, universe))
        more = {"_ntp": "_mtp", "_npred": "_mpred", "_ntrue": "_mtrue", "neutral_pair_total": "_mall", "unresolved_neutral": "_munresolved", "ambiguous_neutral": "_mambiguous"}
        row = row.withColumns({k: F.col(k) + F.col(m) for k, m in more.items()})
    tp = F.col("_tp") - F.col("_ntp")
    row = row.withColumn("true_positive", tp).withColumn("false_positive", F.col("_pred") - F.col("_npred") - tp).withColumn("false_negative", F.col("_true") - F.col("_ntrue") - tp)
    everything = _pairs_of("scored_member_count") - F.col("neutral_pair_total")
    row = row.withColumn("true_negative", F.greatest(everything - F.col("true_positive") - F.col("false_positive") - F.col("false_negative"), F.lit(0)))
    return ratios(row).select("scored_member_count", "true_positive", "false_positive", "false_negative", "true_negative", "precision", "recall", "f1", "neutral_pair_total", *(f"{x}_neutral" for x in NEUTRAL))


def ratios(counts: DataFrame) -> DataFrame:
    """Adds precision, recall, f1 to true_positive, false_positive, false_negative; undefined is null."""
    tp, fp, fn = F.col("true_positive"), F.col("false_positive"), F.col("false_negative")
    p, r = F.when(tp + fp > 0, tp / (tp + fp)), F.when(tp + fn > 0, tp / (tp + fn))
    return counts.withColumn("precision", F.round(p, 4)).withColumn("recall", F.round(r, 4)).withColumn("f1", S.f1(p, r))


def overlapping_pairs(groups: DataFrame) -> DataFrame:
    """first, second of all pairs inside groups that may overlap. For small groups only: it makes the pairs, which count_pairs() does not."""
    a, b = groups.select("group", F.col("id").alias("first")), groups.select("group", F.col("id").alias("second"))
    return a.join(b, "group").where("first < second").select("first", "second").distinct()


def count_pairs(groups: DataFrame, name: str) -> DataFrame:
    """One row: how many pairs of ids are together in any group (group, id); groups may overlap, and no pair is made.

    Of n ids in a group, m of which are in others as well, n (n - 1) / 2 - m (m - 1) / 2 pairs are together nowhere
    else. Ids of the same several groups are a class, and two classes count in the least group that they share. So
    only classes meet, in tiles of a bounded number of them.
    """
    sets = groups.where("group IS NOT NULL AND id IS NOT NULL").groupBy("id").agg(F.array_sort(F.collect_set("group")).alias("set"))
    classes = tables.keep(sets.groupBy("set").agg(F.count("*").alias("n")), "pair-classes")
    several = F.size("set") > 1
    spread = classes.select(F.explode("set").alias("group"), "set", "n")
    size = spread.groupBy("group").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(several, F.col("n"))), F.lit(0)).alias("m"), F.count_if(several).alias("_c"))
    total = lambda d, x, to: d.agg(F.coalesce(F.sum(x), F.lit(0)).alias(to))
    tiled = spread.where(several).join(size.select("group", F.ceil(F.col("_c") / TILE).alias("_tiles")), "group")
    tile, others = F.pmod(F.xxhash64("set"), F.col("_tiles")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_tiles") - 1))
    a = tables.spread(tiled.select("group", tile.alias("_a"), others.alias("_b"), F.col("set").alias("_s"), F.col("n").alias("_n")), "group", "_a", "_b")
    b = tables.spread(tiled.select("group", others.alias("_a"), tile.alias("_b"), F.col("set").alias("_t"), F.col("n").alias("_m")), "group", "_a", "_b")
    met = a.join(b, ["group", "_a", "_b"]).where("_s < _t").where(F.array_min(F.array_intersect("_s", "_t")) == F.col("group"))
    row = total(size, _pairs_of("n") - _pairs_of("m"), "_own").crossJoin(total(classes.where(several), _pairs_of("n"), "_same")).crossJoin(total(met, F.col("_n") * F.col("_m"), "_met"))
    return row.select((F.col("_own") + F.col("_same") + F.col("_met")).alias(name))


def overlapping_confusion(predicted: DataFrame, truth: DataFrame, n_scored: int) -> DataFrame:
    """pair_sets() of the pairs of groups (group, id) that may overlap on either side, without making them.

    A pair is together in a group of either side if it is in a group of both, so these count like groups.
    """
    both = predicted.select("group", "id").join(truth.select(F.col("group").alias("_t"), "id"), "id").where("group IS NOT NULL AND _t IS NOT NULL")
    row = count_pairs(both.select(F.struct("group", "_t").alias("group"), "id"), "true_positive")
    row = row.crossJoin(count_pairs(predicted, "_p")).crossJoin(count_pairs(truth, "_t"))
    row = row.select("true_positive", (F.col("_p") - F.col("true_positive")).alias("false_positive"), (F.col("_t") - F.col("true_positive")).alias("false_negative"))
    rest = F.lit(n_scored * (n_scored - 1) // 2) - F.col("true_positive") - F.col("false_positive") - F.col("false_negative")
    return ratios(row.withColumn("true_negative", F.greatest(rest, F.lit(0))))


def pair_sets(predicted: DataFrame, truth: DataFrame, n_scored: int, neutral: DataFrame | None = None) -> DataFrame:
    """pair_confusion for given sets of pairs (first, second), by set operations."""
    if neutral is not None:
        gone = neutral.where(F.col("label").isin(*NEUTRAL)).select("first", "second")
        predicted, truth = predicted.join(gone, ["first", "second"], "left_anti"), truth.join(gone, ["first", "second"], "left_anti")
    sides = predicted.select("first", "second").distinct().withColumn("_p", F.lit(1)).join(truth.select("first", "second").distinct().withColumn("_t", F.lit(1)), ["first", "second"], "full_outer")
    row = sides.agg(F.count_if(F.col("_p").isNotNull() & F.col("_t").isNotNull()).alias("true_positive"), F.count_if(F.col("_t").isNull()).alias("false_positive"), F.count_if(F.col("_p").isNull()).alias("false_negative"))
    taken = 0 if neutral is None else neutral.where(F.col("label").isin(*NEUTRAL)).select("first", "second").distinct().count()
    rest = F.lit(n_scored * (n_scored - 1) // 2 - taken) - F.col("true_positive") - F.col("false_positive") - F.col("false_negative")
    return ratios(row.withColumn("true_negative", F.greatest(rest, F.lit(0))))


def methods(**tables: DataFrame) -> DataFrame:
    """One row a method from tables of equal columns."""
    out = None
    for name, t in tables.items():
        row = t.withColumn("method", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def micro(reports: DataFrame) -> DataFrame:
    """Per method: counts summed over subjects, and the ratios of the sums."""
    counts = ("scored_member_count", "true_positive", "false_positive", "false_negative", "true_negative", "neutral_pair_total")
    return ratios(reports.groupBy("method").agg(*(F.sum(c).alias(c) for c in counts)))


def neutral_pairs(linkage: DataFrame, universe: DataFrame) -> DataFrame:
    """first, second, label of pairs that can't be judged, among ids that share an origin or lack evidence.

    linkage: id, identities, origins. Ids without identities or origins, or with several origins, make every pair of theirs
    neutral; those are returned as single rows (id, label) by neutral_members(). Pairs here are duplicates: one origin, a
    shared identity; they come from a join on identity.
    """
    rows = linkage.join(universe.select("id").distinct(), "id", "left_semi").where("size(identities) > 0 AND size(array_distinct(origins)) = 1")
    spread = rows.select("id", F.array_distinct("origins")[0].alias("origin"), F.explode(F.array_distinct("identities")).alias("identity"))
    a, b = spread.withColumnRenamed("id", "first"), spread.withColumnRenamed("id", "second")
    return a.join(b, ["origin", "identity"]).where("first < second").select("first", "second", F.lit("duplicate").alias("label")).distinct()


def neutral_members(linkage: DataFrame, universe: DataFrame) -> DataFrame:
    """id, label of ids whose every pair is neutral: unresolved or ambiguous."""
    n = F.coalesce(F.size(F.array_distinct("origins")), F.lit(0))
    label = F.when((F.coalesce(F.size("identities"), F.lit(0)) <= 0) | (n <= 0), "unresolved").when(n > 1, "ambiguous")
    return linkage.join(universe.select("id").distinct(), "id", "left_semi").select("id", label.alias("label")).where("label IS NOT NULL")


def all_neutral_pairs(linkage: DataFrame, universe: DataFrame) -> DataFrame:
    """neutral_pairs() and every pair with a neutral member, unresolved before ambiguous. Makes these pairs: for audits of bounded size."""
    odd = neutral_members(linkage, universe)
    ids = linkage.join(universe.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("other"))
    pairs = odd.join(ids, F.col("id") != F.col("other")).select(F.least("id", "other").alias("first"), F.greatest("id", "other").alias("second"), "label")
    return pairs.groupBy("first", "second").agg(F.max("label").alias("label")).unionByName(neutral_pairs(linkage, universe))


def label_verdicts(labels: DataFrame, symbols: DataFrame) -> DataFrame:
    """Adds verdict: unknown without names, correct if a known name contains the origin, else incorrect. symbols: member, names array."""
    rows = labels.join(symbols.select("member", "names"), "member", "left")
    verdict = F.when(F.coalesce(F.size("names"), F.lit(0)) <= 0, "unknown").when(F.exists("names", lambda n: F.contains(n, F.col("canonical_origin"))), "correct").otherwise("incorrect")
    return rows.withColumn("verdict", verdict).drop("names")


def label_scores(direct: DataFrame, given: DataFrame, truth: DataFrame, symbols: DataFrame, members: DataFrame) -> DataFrame:
    """One row: direct and propagated labels by verdict, precision, coverage, what propagation added and could have added.

    truth: origin, id; members: id of the universe that may be grouped.
    """
    d, g = label_verdicts(direct, symbols), label_verdicts(given, symbols)
    count = lambda v: F.count_if(F.col("verdict") == v)
    n_truth = truth.agg(F.count("*").alias("_truth"))
    row = d.agg(F.count("*").alias("direct_count"), *(count(v).alias(f"direct_{v}") for v in ("correct", "incorrect", "unknown"))).crossJoin(n_truth)
    new = g.join(direct.select("member"), "member", "left_anti")
    row = row.crossJoin(g.agg(F.count("*").alias("propagated_count"), *(count(v).alias(f"propagated_{v}") for v in ("correct", "incorrect", "unknown")))).crossJoin(new.agg(count("correct").alias("newly_correct")))
    seeded = truth.join(direct.select(F.col("member").alias("id")), "id", "left_semi").select("origin").distinct()
    reach = truth.join(seeded, "origin", "left_semi").join(direct.select(F.col("member").alias("id")), "id", "left_anti").join(members.select("id").distinct(), "id", "left_semi")
    row = row.crossJoin(reach.agg(F.count("*").alias("upper_bound")))
    judged = F.col("direct_correct") + F.col("direct_incorrect")
    return row.withColumn("direct_precision", F.when(judged > 0, F.round(F.col("direct_correct") / judged, 4))).withColumn("direct_coverage", F.when(F.col("_truth") > 0, F.round(F.col("direct_count") / F.col("_truth"), 4))).withColumn("opportunity_gap", F.col("upper_bound") - F.col("newly_correct")).drop("_truth")


def catalog_scores(catalog: DataFrame, aliases: DataFrame, direct: DataFrame, given: DataFrame) -> DataFrame:
    """One row: exact (origin, owner) agreement with a catalog (address, origin, owner), ambiguous addresses left out.

    aliases: address of members with several origins; direct, given: address, canonical_origin, owner.
    """
    c = catalog.select("address", F.col("origin").alias("_o"), F.col("owner").alias("_w")).join(aliases.select("address", F.lit(True).alias("_amb")).distinct(), "address", "left")
    base = c.agg(F.count("*").alias("catalog_count"), F.count_if(F.col("_amb").isNull()).alias("evaluable_count"))

    def judged(labels: DataFrame) -> DataFrame:
        rows = labels.select("address", "canonical_origin", "owner").join(c, "address", "left")
        exact = (F.col("canonical_origin") == F.col("_o")) & (F.col("owner") == F.col("_w"))
        verdict = F.when(F.col("_o").isNull(), "unknown").when(F.col("_amb"), "ambiguous").when(exact, "correct").otherwise("incorrect")
        return rows.select("address", verdict.alias("verdict"))

    d, g = judged(direct), judged(given)
    combined = d.unionByName(g.join(d.select("address"), "address", "left_anti"))
    kinds = ("correct", "incorrect", "ambiguous", "unknown")
    row = base
    for name, t in (("direct", d), ("propagated", g), ("combined", combined)):
        row = row.crossJoin(t.agg(*(F.count_if(F.col("verdict") == k).alias(f"{name}_{k}") for k in kinds)))
        row = row.withColumn(f"{name}_precision", S.precision(F.col(f"{name}_correct"), F.col(f"{name}_incorrect"), 6))
        row = row.withColumn(f"{name}_coverage", F.when(F.col("evaluable_count") > 0, F.round(F.col(f"{name}_correct") / F.col("evaluable_count"), 6)))
    return row


def propagation_bound(catalog: DataFrame, aliases: DataFrame, direct: DataFrame) -> DataFrame:
    """origin, known, unknown, pairs of origins with a correct direct label and an unlabelled member: what propagation could reach."""
    c = catalog.join(aliases.select("address").distinct(), "address", "left_anti")
    d = direct.select("address", F.col("canonical_origin").alias("_o"), F.col("owner").alias("_w"), F.lit(True).alias("_direct"))
    rows = c.join(d, "address", "left")
    right = (F.col("_o") == F.col("origin")) & (F.col("_w") == F.col("owner"))
    per = rows.groupBy("origin").agg(F.count_if(right).alias("known"), F.count_if(F.col("_direct").isNull()).alias("unknown"))
    return per.where("known > 0 AND unknown > 0").withColumn("pairs", F.col("known") * F.col("unknown"))
