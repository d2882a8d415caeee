"""Jobs over a run's folder: each reads tables that an earlier one wrote, writes its own, and tells the manifest.

A run's folder holds tables/<name> as Parquet and manifest/ with one line of JSON. Tables are never overwritten; a table's
digest is checked when a later job first reads it, so that a job can't read what no job of this run wrote. analyze() runs
the stages in order and records what each did, refused or could not do.
"""

from __future__ import annotations

import argparse
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions import scalars as S
from kinweave.operators import bodies as B
from kinweave.operators import discovery, families, graph, grouping, labels, profiles, relaxed, retrieval, scoring, similarity, validate
from kinweave.sources import artifacts, payloads

COMPLETED, SKIPPED, UNAVAILABLE, REFUSED = "completed", "skipped", "unavailable", "budget-refused"
VIEWS = ("token", "cfg", "relation")
ALL_VIEWS = (*VIEWS, "composite")
#: Tables that may not depend on labels.
LABEL_BLIND = ("functions", "bodies", "groups", "call_edges", "multi", "consensus2", "consensus3", "families", "final")


@dataclass
class Run:
    """A run's folder, the digests of its tables, and its stages."""

    spark: SparkSession
    root: str
    digests: dict[str, str] = field(default_factory=dict)
    stages: list[dict[str, Any]] = field(default_factory=list)
    #: Tables that this object has written or checked.
    sure: set[str] = field(default_factory=set)

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/tables/{name}"

    def write(self, name: str, df: DataFrame) -> DataFrame:
        self.digests[name] = artifacts.write_table(df, self.path(name))
        self.sure.add(name)
        return self.spark.read.parquet(self.path(name))

    def read(self, name: str) -> DataFrame:
        """A table of this run; an error if it isn't what the run recorded."""
        df = self.spark.read.parquet(self.path(name))
        if name not in self.sure and self.digests.get(name) != artifacts.table_digest(df):
            raise validate.Invalid(f"{name} is not the table that this run recorded")
        self.sure.add(name)
        return df

    def told(self, stage: str) -> dict[str, Any]:
        """What the last run of a stage recorded."""
        found = [s for s in self.stages if s["stage"] == stage]
        if not found:
            raise validate.Invalid(f"this run has no stage {stage}")
        return found[-1]

    def tell(self, stage: str, status: str, **what) -> dict[str, Any]:
        self.stages.append({"stage": stage, "status": status, **what})
        return self.stages[-1]

    def manifest(self, **more) -> dict[str, Any]:
        blind = {n: self.digests[n] for n in LABEL_BLIND if n in self.digests}
        return {"artifact": "analysis-manifest", "schema_version": artifacts.SCHEMA_VERSION, "tables": dict(sorted(self.digests.items())), "stages": self.stages, "label_blind": blind, "toolchain": artifacts.fingerprint(self.spark), **more}

    def publish(self, **more) -> dict[str, Any]:
        made = self.manifest(**more)
        line = artifacts.canonical_bytes(made).decode()
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root.rstrip('/')}/manifest")
        return made

    @classmethod
    def load(cls, spark: SparkSession, root: str) -> Run:
        """The run that a manifest tells of."""
        found = json.loads(spark.read.text(f"{root.rstrip('/')}/manifest").first()["value"])
        return cls(spark, root, dict(found["tables"]), list(found["stages"]))


def discover(run: Run, sources: list[DataFrame], transfers: DataFrame, possible: DataFrame, seen: DataFrame, decoded: DataFrame, bytes_read: DataFrame, entry: int | None = None) -> None:
    """Tables functions, bodies, transfers, abstentions, call_edges, groups, signatures of merged sources and what decoders delivered.

    sources: functions, the first source first; decoded: instructions as normalize_instructions() takes them; bytes_read: id, bytes_read.
    """
    merged = discovery.merge_sources(*sources)
    resolved = run.write("transfers", discovery.resolve_indirect(discovery.classify_targets(discovery.latest_per_site(transfers, "seq"), merged), possible, seen))
    nodes, edges = discovery.call_graph(merged, resolved)
    nodes = nodes.withColumn("id", S.function_id(F.col("address")))
    ins = B.normalize_instructions(decoded)
    sizes = nodes.where("kind <> 'opaque'").select("id", "size").join(bytes_read.select("id", "bytes_read"), "id", "left")
    quality = B.completeness(sizes, ins)
    ins = run.write("instructions", ins)
    blocks = run.write("blocks", B.blocks(ins, sizes))
    cfg = run.write("cfg_edges", B.cfg_edges(blocks))
    run.write("bodies", B.checked(B.assemble(sizes.select("id", "size"), ins, blocks, cfg, quality.join(B.opaque_jumps(blocks), "id", "left"))))
    root = None if entry is None else discovery.choose_root(merged, entry)
    known = nodes.join(quality.select("id", F.col("complete_decode")), "id", "left").select("address", "complete_decode")
    classified = run.write("functions", discovery.classify(nodes.drop("id"), known, root).withColumn("id", S.function_id(F.col("address"))))
    abstained = run.write("abstentions", discovery.abstentions(classified))
    by_id = edges.select(S.function_id(F.col("src")).alias("src"), S.function_id(F.col("dst")).alias("dst"), "count")
    status = discovery.relation_status(classified, by_id)
    visible = run.write("call_edges", discovery.visible_edges(by_id, status))
    placed = status.where(F.col("relation_status").isin("member", "context")).select("id", (F.col("relation_status") == "member").alias("is_member"), F.col("colour").alias("anchor"))
    placed = run.write("nodes", placed)
    colours = graph.refine(placed, visible)
    groups = run.write("groups", graph.clusters(colours))
    last = colours.agg(F.max("round")).first()[0]
    run.write("signatures", graph.signatures(visible, colours.where(F.col("round") == last)))
    counts = {r["role"]: r["n"] for r in classified.groupBy("role").agg(F.count("*").alias("n")).collect()}
    # a block's label is its place in the body and tells nothing
    payloads.stage_tables(classified, resolved, run.read("bodies").drop("blocks"), visible, groups, placed, abstained)
    core = payloads.core_digest(run.digests["instructions"], None if root is None else str(root), classified, visible, groups, abstained)
    run.tell("discovery", COMPLETED, root=root, core_sha256=core, **counts)


def retrieve(run: Run, k: int = 16, views: tuple[str, ...] = VIEWS) -> None:
    """Tables multi, consensus3, consensus2: one search a view, united and annotated once, and what three or two views agree on.

    With fewer views than that all of them must agree. The stage records a manifest of each queue.
    """
    if not set(views) <= set(ALL_VIEWS) or not views:
        raise ValueError(f"views are some of {', '.join(ALL_VIEWS)}")
    bodies = run.read("bodies")
    ids = bodies.where("complete_decode").select("id")
    ins = run.read("instructions").join(ids, "id", "left_semi")
    found = []
    if "token" in views:
        found.append(retrieval.top_k(profiles.token_profiles(ids, profiles.token_features(ins)), retrieval.TOKEN, k))
    if "cfg" in views:
        blocks, edges = (run.read(t).join(ids, "id", "left_semi") for t in ("blocks", "cfg_edges"))
        found.append(retrieval.top_k(profiles.cfg_profiles(ids, blocks, edges, profiles.cfg_features(blocks, edges)), retrieval.CFG, k))
    groups = run.read("groups")
    if "relation" in views:
        anchors = run.read("nodes").where("NOT is_member AND anchor IS NOT NULL").select("id", F.col("anchor").alias("colour"))
        found.append(retrieval.top_k(profiles.relation_profiles(ids, groups, run.read("call_edges"), anchors), retrieval.RELATION, k))
    if "composite" in views:
        sizes = run.read("functions").join(ids, "id", "left_semi").select("id", "size").join(run.read("bodies").select("id", F.size("instructions").alias("instruction_count"), F.size("blocks").alias("block_count")), "id")
        found.append(retrieval.top_k(profiles.cheap_profiles(sizes, profiles.token_features(ins)), retrieval.COMPOSITE, k))
    last = groups.agg(F.max("round")).first()[0]
    multi = run.write("multi", retrieval.annotate(retrieval.unite(*found), groups, run.read("signatures"), last or 0))
    validate.assert_none(validate.candidate_faults(multi, bodies, views, k), "candidates")
    who = payloads.subject(run.digests["instructions"])
    evidence = {"subject_sha256": run.digests["instructions"], "body_sha256": run.digests["bodies"]}
    of = lambda table, name, **rule: payloads.queue_manifest(table, bodies, k, views, who, evidence, payloads.relation_summary(groups), sha256=run.digests[name], **rule)
    queues = {"multi": of(multi, "multi")}
    for n in (3, 2):
        name, agreed = f"consensus{n}", min(n, len(views))
        queues[name] = of(run.write(name, retrieval.consensus(multi, agreed)), name, minimum_views=agreed, source=queues["multi"]["pairs_sha256"])
    run.tell("retrieval", COMPLETED, queues=queues, **{name: q["pair_count"] for name, q in queues.items()})


def budget(run: Run, policy: S.PairPolicy) -> str:
    """Table budgeted: the pairs of those components of the strict queue that fit the policy, whole, cheapest first."""
    queue, bodies = run.read("consensus3"), run.read("bodies")
    lengths = bodies.select("id", F.size("instructions").cast("long").alias("n"))
    members = run.write("queue_components", graph.components(bodies.select("id"), queue.select("first", "second")))
    costs = run.write("component_costs", grouping.component_costs(members, lengths.join(grouping.usable(bodies, policy).select("id"), "id", "left_semi")))
    admitted = run.write("admitted", grouping.admit(costs, policy))
    run.write("budgeted", grouping.budgeted(queue, members, admitted))
    row = admitted.agg(F.count_if("selected").alias("selected"), F.count_if(~F.col("selected")).alias("deferred"), F.sum(F.when(F.col("selected"), F.col("cells"))).alias("cells")).first()
    run.tell("component-budget", COMPLETED, **row.asDict())
    return "budgeted"


def group(run: Run, policy: S.PairPolicy, queue: str = "consensus3") -> str:
    """Table families of a queue, or a refusal of the whole queue."""
    bodies = run.read("bodies")
    status, table, cost = grouping.strict_families(run.read(queue).select("first", "second"), bodies, policy, similarity.features)
    if table is None:
        run.tell("strict", status, **cost)
        return status
    table = run.write("families", table)
    validate.assert_none(validate.family_faults(table, bodies), "families")
    run.tell("strict", status, **cost, **{r["status"]: r["members"] for r in grouping.summary(table).collect()})
    return status


def rescue(run: Run, max_members: int = 64, max_comparisons: int = 4096, max_cells: int = 500_000_000) -> None:
    """Tables rescue, final: fragments joined by the wider queue, tested for two independent axes, and joined if they pass."""
    fragments = families.fragments_of(run.read("families"))
    bodies, ins = run.read("bodies"), run.read("instructions")
    comp, bridges = families.rescue_components(fragments, run.read("consensus2"))
    comp, bridges = run.write("rescue_components", comp), run.write("rescue_bridges", bridges)
    members = fragments.join(comp, "fragment").select("component", "id")
    costs = families.reserve(members, bodies.select("id", F.size("instructions").cast("long").alias("n")))
    allowed = families.rescue(comp.select("component").distinct(), costs, comp.select("component", F.lit("open").alias("status"), F.lit(None).cast("string").alias("reason")).distinct(), max_members, max_comparisons, max_cells)
    allowed = run.write("rescue_admitted", allowed)
    # components that are admitted are of max_members at most, so their pairs are bounded
    mine = members.join(allowed.where("status = 'open'").select("component"), "component", "left_semi").join(bridges.select("component").distinct(), "component", "left_semi").withColumnRenamed("component", "family")
    pairs = mine.select("family", F.col("id").alias("first")).join(mine.select("family", F.col("id").alias("second")), "family").where("first < second")
    scored = similarity.features(pairs.select("first", "second").distinct(), bodies).select("first", "second", F.col("structure_score").alias("score"))
    medoid = run.write("rescue_medoids", families.medoids(pairs.join(scored, ["first", "second"])))
    others = mine.join(medoid.select("family", "medoid"), "family").where("id <> medoid")
    aligned = similarity.alignments(others.select(F.col("medoid").alias("first"), F.col("id").alias("second")), bodies)
    aligned = others.join(aligned, (F.col("medoid") == F.col("first")) & (F.col("id") == F.col("second"))).select("family", "id", F.explode("instruction_pairs").alias("p")).select("family", "id", F.col("p.first").alias("medoid_offset"), F.col("p.second").alias("member_offset"))
    functions = run.read("functions").select("id", "address")
    transfers = run.read("transfers").select("source", "callsite", "kind", "status", "target", F.coalesce(F.size("possible_targets"), F.lit(0)).alias("n_targets"))
    observed = families.slots(ins.join(mine.select("id"), "id", "left_semi"), functions, families.unique_sites(transfers))
    axes = run.write("rescue_axes", families.axes(families.template(mine, medoid, observed, aligned)))
    finer, covered = families.refinements(axes), families.coverage(axes)
    top = families.maximal(axes, finer)
    chosen = families.basis(axes, covered, finer, top)
    reasons = families.rescue_reasons(comp.select("component").distinct(), bridges, axes, covered, top, chosen, families.internal_support(axes, fragments))
    verdicts = allowed.where("status <> 'open'").select("component", "status", "reason").unionByName(reasons.join(allowed.where("status = 'open'").select("component"), "component", "left_semi"))
    verdicts = run.write("rescue", verdicts)
    final = run.write("final", families.final_partition(fragments, comp, verdicts))
    validate.assert_none(validate.partition_faults(final, fragments.withColumnRenamed("fragment", "family_id")), "final partition")
    run.tell("rescue", COMPLETED, **{r["status"]: r["n"] for r in verdicts.groupBy("status").agg(F.count("*").alias("n")).collect()})


def relax(run: Run, policy: S.PairPolicy) -> str:
    """Tables relaxed_decisions, relaxed_accounting, relaxed_strict and relaxed_rescued of one priced set of pairs."""
    final = run.read("final") if "final" in run.digests else None
    status, out, price = relaxed.build(run.read("families"), run.read("consensus2"), run.read("bodies"), policy, similarity.features, final)
    queues = run.told("retrieval")["queues"]
    payloads.check_queue(queues["multi"], queues["consensus2"], min(2, len(queues["multi"]["config"]["views"])))
    names = {"decisions": "relaxed_decisions", "accounting": "relaxed_accounting", relaxed.STRICT: "relaxed_strict", relaxed.RESCUED: "relaxed_rescued"}
    counts = {}
    for key, table in out.items():
        kept = run.write(names[key], table.withColumn("families", F.array_join("families", ",")) if "families" in table.columns else table)
        if key in (relaxed.STRICT, relaxed.RESCUED):
            counts[key] = {r["outcome"]: r["n"] for r in kept.groupBy("outcome").agg(F.count("*").alias("n")).collect()}
    run.tell("relaxed", status, **price, **counts)
    return status


def propagate(run: Run, raw: DataFrame, partition: str = "strict") -> None:
    """Tables labels, direct, label_families, propagated of raw labels (address, mapped_address, name, evidence)."""
    found = run.write("labels", labels.bucket_labels(raw, run.read("functions").select("address")))
    validate.assert_none(validate.label_faults(found), "labels")
    rows = relaxed.strict_cores(run.read("families")) if partition == "strict" else run.read("final").select("family_id", "id")
    direct, fams, given = labels.propagate(rows, labels.seeds(found), run.read("bodies").select("id"))
    direct, fams, given = run.write("direct", direct), run.write("label_families", fams), run.write("propagated", given)
    run.tell("propagation", COMPLETED, **labels.opportunity(direct, fams, given, rows, run.read("bodies").select("id")).first().asDict())


def evaluate(run: Run, truth: DataFrame, neutral: DataFrame | None = None, linkage: DataFrame | None = None, outside: DataFrame | None = None) -> DataFrame:
    """One row a method: pair confusion of relation groups (v0), strict, rescued and relaxed ones against truth (origin, id).

    neutral or linkage: what can't be judged, as scoring.pair_confusion() takes it; outside: groups of another engine (group,
    id) in place of the run's own relation groups.
    """
    universe = run.read("bodies").select("id")
    strict = run.read("families")
    if outside is None:
        groups = run.read("groups")
        last = groups.agg(F.max("round")).first()[0]
        outside = groups.where(F.col("round") == last).select(F.col("cluster").alias("group"), "id")
    count = lambda predicted: scoring.pair_confusion(predicted, truth, universe, neutral, linkage)
    tables = {"v0": count(outside), "strict": count(strict.select(F.col("family_id").alias("group"), "id"))}
    cores = {"relaxed": ("relaxed_strict", relaxed.strict_cores(strict))}
    if "final" in run.digests:
        final = run.read("final")
        rest = strict.join(final.select("id"), "id", "left_anti").select(F.col("family_id").alias("group"), "id")
        tables["rescued"] = count(final.select(F.col("family_id").alias("group"), "id").unionByName(rest))
        cores["rescue-relaxed"] = ("relaxed_rescued", relaxed.rescued_cores(final))
    columns = ["scored_member_count", "true_positive", "false_positive", "false_negative", "true_negative", "precision", "recall", "f1", "neutral_pair_total"]
    for method, (name, core) in cores.items():
        if name in run.digests:
            tables[method] = relaxed.variant_score(run.read(name), core, truth, universe).withColumn("neutral_pair_total", F.lit(0).cast("long"))
    return run.write("scores", scoring.methods(**{k: t.select(*columns) for k, t in tables.items()}))


def evaluate_catalog(run: Run, catalog: DataFrame, aliases: DataFrame) -> DataFrame:
    """Exact agreement of direct and propagated labels with a catalog (address, origin, owner)."""
    decoded = lambda t: t.withColumn("address", S.address_of_id(F.col("member")).cast("long"))
    return run.write("catalog_scores", scoring.catalog_scores(catalog, aliases, decoded(run.read("direct")), decoded(run.read("propagated"))))


def predict(run: Run, policy: S.PairPolicy, root: str) -> Run:
    """Relaxed predictions from a run's families, published in a run of their own; made twice, and an error if the two differ."""
    def once(where: str) -> Run:
        made = Run(run.spark, where, stages=[s for s in run.stages if s["stage"] in ("retrieval", "strict")])
        for name in ("families", "consensus2", "bodies", "groups", *(["final"] if "final" in run.digests else [])):
            if made.write(name, run.read(name)) and made.digests[name] != run.digests[name]:
                raise validate.Invalid(f"{name} changed while it was copied")
        relax(made, policy)
        made.publish(truth_opened=False)
        return made

    first, second = once(f"{root}/predictions"), once(f"{root}/rebuilt")
    validate.assert_agreement("predictions and their rebuild", first.digests, second.digests, tuple(n for n in first.digests if n.startswith("relaxed")))
    return first


def replay(runs: dict[str, Run], policy: S.PairPolicy, root: str, truths: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """Scores by method over several subjects. The predictions of all are made and published before any truth is opened."""
    if set(runs) != set(truths):
        raise ValueError("each run needs a truth")
    for subject, run in runs.items():
        predict(run, policy, f"{root}/{subject}")
    reports = None
    for subject in runs:
        made = Run.load(runs[subject].spark, f"{root}/{subject}/predictions")
        rows = evaluate(made, truths[subject]()).withColumn("subject", F.lit(subject))
        made.publish(truth_opened=True)
        reports = rows if reports is None else reports.unionByName(rows)
    return scoring.micro(reports)


def dry_price(run: Run, policy: S.PairPolicy) -> dict[str, Any]:
    """What relax() would compare and cost; nothing is compared or written to the run."""
    strict = run.read("families")
    cores = {relaxed.STRICT: relaxed.strict_cores(strict)} | ({relaxed.RESCUED: relaxed.rescued_cores(run.read("final"))} if "final" in run.digests else {})
    possible, bodies = relaxed.possible_pairs(run.read("consensus2"), strict, cores), run.read("bodies")
    lengths = bodies.select("id", F.size("instructions").cast("long").alias("n"))
    return grouping.price(possible.select("first", "second").distinct(), lengths, grouping.usable(bodies, policy), policy).first().asDict()


def analyze(run: Run, policy: S.PairPolicy, inputs: dict[str, Any], raw_labels: DataFrame | None = None, k: int = 16, component_budgeted: bool = False) -> dict[str, Any]:
    """All stages, with what each did or could not do; returns the manifest. inputs: the arguments of discover()."""
    began = time.perf_counter()
    discover(run, **inputs)
    retrieve(run, k)
    queue = budget(run, policy) if component_budgeted else "consensus3"
    if group(run, policy, queue) == COMPLETED:
        rescue(run)
        try:
            relax(run, policy)
        except Exception as e:  # a stage that fails is told, and the others' tables stay
            run.tell("relaxed", UNAVAILABLE, reason=str(e)[:500])
        if raw_labels is None:
            run.tell("propagation", SKIPPED, reason="no labels")
        else:
            propagate(run, raw_labels)
    else:
        for stage in ("rescue", "relaxed", "propagation"):
            run.tell(stage, SKIPPED, reason="no strict families")
    return run.publish(command={"top_k": k, "component_budgeted": component_budgeted}, execution={"duration_seconds": round(time.perf_counter() - began, 3)})


def verify_label_blind(run: Run, policy: S.PairPolicy, inputs: dict[str, Any], **how) -> dict[str, Any]:
    """Runs all stages again without labels; an error if a table that may not depend on labels comes out differently."""
    again = analyze(Run(run.spark, f"{run.root.rstrip('/')}/blind"), policy, inputs, None, **how)
    mine = run.manifest()["label_blind"]
    validate.assert_agreement("runs with and without labels", mine, again["label_blind"], tuple(sorted(set(mine) | set(again["label_blind"]))))
    return again


def inputs_of(spark: SparkSession, folder: str, sources: list[str], entry: int | None) -> dict[str, Any]:
    """The arguments of discover() from Parquet tables in a folder; sources: names of the tables of functions, the first source first."""
    table = lambda name: spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    return {"sources": [table(s) for s in sources], **{n: table(n) for n in ("transfers", "possible", "seen", "decoded", "bytes_read")}, "entry": entry}


def main(argv: list[str] | None = None) -> int:
    """One job over a run's folder; 2 if a budget refuses it."""
    parser = argparse.ArgumentParser(description=main.__doc__)
    parser.add_argument("job", choices=("analyze", "discover", "retrieve", "budget", "group", "rescue", "dry-price", "relax", "propagate", "evaluate", "evaluate-catalog", "predict"))
    parser.add_argument("root", help="the run's folder")
    parser.add_argument("--inputs", help="folder of the tables that discovery reads")
    parser.add_argument("--sources", default="functions", help="tables of functions, by commas, the first source first")
    parser.add_argument("--entry", type=lambda x: int(x, 0))
    parser.add_argument("--top-k", type=int, default=16)
    parser.add_argument("--views", default=",".join(VIEWS), help=f"some of {','.join(ALL_VIEWS)}")
    parser.add_argument("--queue", default="consensus3")
    parser.add_argument("--component-budgeted", action="store_true")
    parser.add_argument("--partition", choices=("strict", "rescued"), default="strict")
    parser.add_argument("--table", help="Parquet of raw labels (analyze, propagate), truth (evaluate) or a catalog (evaluate-catalog)")
    parser.add_argument("--aliases", help="Parquet of a catalog's aliases")
    parser.add_argument("--linkage", help="Parquet of a linkage audit")
    parser.add_argument("--no-labels", action="store_true")
    parser.add_argument("--verify-label-blind", action="store_true")
    parser.add_argument("--out", help="folder of predictions")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    policy = S.PairPolicy()
    table = lambda path: spark.read.parquet(path) if path else None
    if args.job in ("analyze", "discover"):
        run, inputs = Run(spark, args.root), inputs_of(spark, args.inputs, args.sources.split(","), args.entry)
        if args.job == "discover":
            discover(run, **inputs)
            run.publish()
            return 0
        how = {"k": args.top_k, "component_budgeted": args.component_budgeted}
        made = analyze(run, policy, inputs, None if args.no_labels else table(args.table), **how)
        if args.verify_label_blind:
            verify_label_blind(run, policy, inputs, **how)
        return 2 if any(s["status"] == REFUSED for s in made["stages"]) else 0
    run = Run.load(spark, args.root)
    if args.job == "dry-price":
        price = dry_price(run, policy)
        print(json.dumps(price, default=str))
        return 0 if price["within_budget"] else 2
    if args.job == "predict":
        return 2 if predict(run, policy, args.out).told("relaxed")["status"] == REFUSED else 0
    status = {
        "retrieve": lambda: retrieve(run, args.top_k, tuple(args.views.split(","))),
        "budget": lambda: budget(run, policy),
        "group": lambda: group(run, policy, args.queue),
        "rescue": lambda: rescue(run),
        "relax": lambda: relax(run, policy),
        "propagate": lambda: propagate(run, table(args.table), args.partition),
        "evaluate": lambda: evaluate(run, table(args.table), linkage=table(args.linkage)),
        "evaluate-catalog": lambda: evaluate_catalog(run, table(args.table), table(args.aliases)),
    }[args.job]()
    run.publish()
    return 2 if isinstance(status, str) and status == REFUSED else 0


if __name__ == "__main__":
    raise SystemExit(main())
