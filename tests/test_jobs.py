"""A run from decoded instructions to scores, and the builders of relaxed attachments."""

import pytest
from pyspark.sql import functions as F

from kinweave import jobs
from kinweave.functions import scalars as S
from kinweave.operators import relaxed, scoring, validate
from kinweave.sources import payloads

DECODED = "id string, address long, function_size long, offset long, size long, mnemonic string, operand_text string, operand_kinds array<string>, groups array<string>"


def fid(address):
    return f"FUN_{address + 0x100000:08x}"


def inputs(spark):
    """Six functions: three alike, two alike, one of its own; the first calls all others."""
    kinds = {"x": [("mov", "eax, 0x5", ["register", "immediate"], []), ("add", "rax, rbx", ["register", "register"], []), ("cmp", "eax, 0x7", ["register", "immediate"], []), ("ret", "", [], ["ret"])], "y": [("lea", "rcx, [rsp + 8]", ["register", "memory"], []), ("sub", "ecx, 0x9", ["register", "immediate"], []), ("ret", "", [], ["ret"])]}
    shape = {0x2000: "x", 0x3000: "x", 0x4000: "x", 0x5000: "y", 0x6000: "y"}
    rows, functions = [], []
    for a, k in shape.items():
        rows += [(fid(a), a, 4 * len(kinds[k]), 4 * i, 4, *ins) for i, ins in enumerate(kinds[k])]
        functions.append((a, 4 * len(kinds[k]), f"f{a}", "table", "fcn"))
    calls = [("call", f"0x{a:x}", ["immediate"], ["call"]) for a in shape]
    rows += [(fid(0x1000), 0x1000, 4 * len(calls), 4 * i, 4, *ins) for i, ins in enumerate(calls)]
    functions.append((0x1000, 4 * len(calls), "start", "table", "fcn"))
    transfers = [(0x1000, 0x1000 + 4 * i, i, a, "immediate", "call") for i, a in enumerate(shape)]
    none = spark.createDataFrame([], "source long, callsite long, target long")
    return {
        "sources": [spark.createDataFrame(functions, "address long, size long, name string, boundary_source string, kind string")],
        "transfers": spark.createDataFrame(transfers, "source long, callsite long, seq long, target long, operand_kind string, kind string").withColumn("resolver", F.lit(None).cast("string")),
        "possible": none, "seen": none.select("source", "callsite"), "decoded": spark.createDataFrame(rows, DECODED),
        "bytes_read": spark.createDataFrame([(fid(a), 64) for a, *_ in functions], "id string, bytes_read long"), "entry": 0x1000,
    }


def test_a_run_from_instructions_to_scores(spark, tmp_path):
    run = jobs.Run(spark, f"file://{tmp_path}/run")
    raw = spark.createDataFrame([(0x2000, None, "a::f::<T>", "direct-flirt"), (0x9999, None, "b::g", "direct-flirt")], "address long, mapped_address long, name string, evidence string")
    policy = S.PairPolicy()
    made = jobs.analyze(run, policy, inputs(spark), raw, k=5)
    status = {s["stage"]: s["status"] for s in made["stages"]}
    assert status == dict.fromkeys(("discovery", "retrieval", "strict", "rescue", "relaxed", "propagation"), "completed")
    groups = {}
    for r in run.read("families").collect():
        groups.setdefault(r.family_id, set()).add(r.id)
    assert sorted(map(sorted, groups.values())) == [[fid(0x1000)], [fid(a) for a in (0x2000, 0x3000, 0x4000)], [fid(0x5000), fid(0x6000)]]
    assert {r.member for r in run.read("propagated").collect()} == {fid(0x3000), fid(0x4000)}
    assert {r.id: r.role for r in run.read("functions").collect()}[fid(0x1000)] == "context-only"
    again = jobs.Run.load(spark, run.root)
    assert again.digests == run.digests and set(made["label_blind"]) >= {"families", "multi"}
    truth = spark.createDataFrame([("x", fid(a)) for a in (0x2000, 0x3000, 0x4000)] + [("y", fid(0x5000)), ("y", fid(0x6000)), ("z", fid(0x1000))], "origin string, id string")
    scores = {r.method: r for r in jobs.evaluate(again, truth).collect()}
    v0 = scores.pop("v0")
    assert all((s.true_positive, s.false_positive, s.false_negative, s.f1) == (4, 0, 0, 1.0) for s in scores.values()) and set(scores) == {"strict", "rescued", "relaxed", "rescue-relaxed"}
    assert (v0.true_positive, v0.false_positive, v0.false_negative) == (4, 6, 0)  # all that the first calls have one colour
    queues = again.told("retrieval")["queues"]
    assert queues["consensus2"]["provenance"]["derivation"]["source_sha256"] == run.digests["multi"] == queues["multi"]["pairs_sha256"]
    opened = []
    total = {r.method: r for r in jobs.replay({"one": jobs.Run.load(spark, run.root)}, policy, f"file://{tmp_path}/replay", {"one": lambda: opened.append(1) or truth}).collect()}
    assert opened == [1] and total["relaxed"].true_positive == 4 and set(total) == {"v0", *scores}
    assert jobs.dry_price(again, policy)["within_budget"]
    catalog = spark.createDataFrame([(a, "a::f", "a") for a in (0x2000, 0x3000)] + [(0x4000, "other", "a")], "address long, origin string, owner string")
    row = jobs.evaluate_catalog(again, catalog, catalog.where("false")).first()
    assert (row.direct_correct, row.direct_unknown, row.propagated_correct, row.propagated_incorrect) == (1, 1, 1, 1)
    other = jobs.Run.load(spark, run.root)
    other.digests["families"] = "0"
    with pytest.raises(validate.Invalid):
        other.read("families")


def test_relaxed_builders(spark, tmp_path):
    bodies = spark.createDataFrame([(i, [0] * n, i != "s3", 0) for i, n in (("k1", 2), ("k2", 3), ("k3", 4), ("k4", 5), ("s1", 6), ("s2", 7), ("s3", 8))], "id string, instructions array<int>, complete_decode boolean, opaque_indirect_jumps int")
    fam = spark.createDataFrame([("k1", "K", "accepted"), ("k2", "K", "accepted"), ("k3", "L", "accepted"), ("k4", "L", "accepted"), ("s1", "1", "unresolved"), ("s2", "2", "provisional"), ("s3", "3", "unresolved")], "id string, family_id string, status string")
    pairs = spark.createDataFrame([("k1", "s1"), ("k3", "s2"), ("k1", "s2"), ("k1", "s3")], "first string, second string")
    final = spark.createDataFrame([("K+L", k) for k in ("k1", "k2", "k3", "k4")], "family_id string, id string")

    def features(asked, _):
        good = F.col("second").isin("s1") | ((F.col("second") == "s2") & F.col("first").isin("k1", "k3"))
        return asked.select("first", "second", F.when(good, 1.0).otherwise(0.5).alias("structure_score"), F.lit(1.0).alias("constant_similarity"), F.lit(None).cast("double").alias("data_reference_similarity"), F.lit(True).alias("both_complete"), F.lit(0).alias("opaque_indirect_jumps"))

    status, out, price = relaxed.build(fam, pairs, bodies, S.PairPolicy(), features, final)
    assert status == "completed" and set(out) == {"decisions", "accounting", relaxed.STRICT, relaxed.RESCUED}
    got = {(r.first, r.second): (r.decision, r.source) for r in out["decisions"].collect()}
    assert got["k1", "s1"] == ("match", "candidate") and got["k2", "s1"] == ("match", "on-demand") and got["k1", "s3"] == ("abstain", "candidate") and len(got) == 12
    strict = {r.id: (r.outcome, r.family_id) for r in out[relaxed.STRICT].collect()}
    assert strict == {"s1": ("attached", "K"), "s2": ("ambiguous", None), "s3": ("unassigned", None)}
    wide = {r.id: (r.outcome, r.family_id, r.n_unknown) for r in out[relaxed.RESCUED].collect()}
    assert wide["s1"] == ("attached", "K+L", 0) and wide["s2"] == ("attached", "K+L", 2)
    row = out["accounting"].first()
    assert (row.possible_pairs, row.total_comparisons, row.total_cells, row.abstained, row.candidate_comparisons) == (12, 8, (2 + 3 + 4 + 5) * 13, 4, 3)
    assert price["required_comparisons"] == 8 and row.remaining_comparisons == 9992
    assert relaxed.build(fam, pairs, bodies, S.PairPolicy(max_comparisons=3), features, final)[:2] == ("budget-refused", {})
    truth = spark.createDataFrame([("x", "k1"), ("x", "k2"), ("x", "s1"), ("y", "k3"), ("y", "k4"), ("y", "s2"), ("z", "s3")], "origin string, id string")
    score = relaxed.variant_score(out[relaxed.STRICT], relaxed.strict_cores(fam), truth, bodies).first()
    assert (score.true_positive, score.false_positive, score.false_negative, score.true_negative) == (4, 0, 2, 15)


def test_payloads(spark):
    assert payloads.partition_rows({"a": ["x", "y"]}) == payloads.partition_rows([{"id": "a", "members": ["y", "x"]}]) == [("a", "x"), ("a", "y")]
    assert payloads.partition_rows([["y", "x"]]) == [("x", "x"), ("x", "y")]
    for wrong in ({"a": ["x"]}, {"a": ["x", "y"], "b": ["y", "z"]}, [["x", "x"]]):
        with pytest.raises(validate.Invalid):
            payloads.partition_rows(wrong)
    odd = spark.createDataFrame([("f", 1, 2)], "id string, opaque_indirect_jump_count long, opaque_indirect_jumps long")
    with pytest.raises(Exception, match="conflicting"):
        payloads.opaque_alias(odd).collect()
    pairs = spark.createDataFrame([("a", "b")], "first string, second string")
    bodies = spark.createDataFrame([("a", True), ("b", False)], "id string, complete_decode boolean")
    who = payloads.subject("ab" * 32)
    multi = payloads.queue_manifest(pairs, bodies, 16, ("token",), who, {"subject_sha256": "s", "body_sha256": "b"})
    two = payloads.queue_manifest(pairs, bodies, 16, ("token",), who, multi["provenance"], minimum_views=2, source=multi["pairs_sha256"])
    payloads.check_queue(multi, two, 2)
    with pytest.raises(validate.Invalid):
        payloads.check_queue(multi, two, 3)
    with pytest.raises(validate.Invalid):
        payloads.check_queue(multi | {"case": "other"}, two, 2)
    groups = spark.createDataFrame([(0, "a", "C1"), (1, "a", "C1"), (1, "b", "C2")], "round int, id string, cluster string")
    assert payloads.relation_summary(groups) == {"rounds": 2, "final_round": 1, "final_group_count": 2, "prior_round_count": 1}
    empty = spark.createDataFrame([], "src string, dst string, count long")
    f = spark.createDataFrame([("a", 1, "secret")], "id string, address long, name string")
    stages = payloads.stage_tables(f, empty, bodies, empty, groups, empty, empty)
    assert stages["discovery"]["functions"].columns == ["id", "address"]
    assert payloads.core_digest("s", None, f, empty, groups, empty) == payloads.core_digest("s", None, f.withColumn("name", F.lit("x")), empty, groups, empty)
    with pytest.raises(validate.Invalid):
        payloads.stage_tables(f, empty.withColumn("owner", F.lit("x")), bodies, empty, groups, empty, empty)


def test_audits_and_outside_groups(spark):
    a, b, c = "a" * 64, "b" * 64, "c" * 64
    audit = {"case": "x", "build": "O2", "profile": "p", "provenance": {"ground_truth_sha256": a, "stripped_sha256": b, "non_stripped_sha256": c}}
    run, truth = {"binary": {"sha256": b}, "case": "x"}, {"build": "O2", "provenance": {"non_stripped_sha256": c}}
    payloads.check_audit(audit, run, truth, a)
    payloads.check_audit({**audit, "provenance": {"ground_truth_sha256": a}}, run, {}, a)
    wrong = [
        (audit, run, truth, b), (audit, run, truth, "no digest"), (audit, {"binary": {"sha256": c}}, truth, a), (audit, run, {**truth, "build": "O3"}, a), (audit, {**run, "case": "y"}, truth, a), (audit, run, {}, a),
        ({**audit, "profile": None}, run, truth, a), ({**audit, "provenance": None}, run, truth, a), ({**audit, "provenance": {"ground_truth_sha256": a, "stripped_sha256": "b"}}, run, truth, a),
    ]
    for case in wrong:
        with pytest.raises(validate.Invalid):
            payloads.check_audit(*case)
    groups, left = spark.createDataFrame([("g", "a"), ("g", "b")], "group string, id string"), spark.createDataFrame([("c",)], "id string")
    assert payloads.outside_groups(groups, left, spark.createDataFrame([("a",), ("b",), ("c",)], "id string")).count() == 2
    for ids in ("ab", "abcd"):
        with pytest.raises(validate.Invalid):
            payloads.outside_groups(groups, left, spark.createDataFrame([(i,) for i in ids], "id string"))


def test_confusion_by_linkage(spark):
    """Counts of a linkage are those of its neutral pairs, all made."""
    link = spark.createDataFrame(
        [("a", ["i"], ["o"]), ("b", ["i"], ["o"]), ("c", ["j"], ["o", "p"]), ("d", [], []), ("e", ["k"], ["p"]), ("f", None, None), ("g", ["l"], ["q", "q"])],
        "id string, identities array<string>, origins array<string>",
    )
    truth = spark.createDataFrame([("o", "a"), ("o", "b"), ("o", "c"), ("p", "d"), ("p", "e"), ("p", "f"), ("q", "g"), ("q", "h")], "origin string, id string")
    found = spark.createDataFrame([("1", "a"), ("1", "b"), ("1", "c"), ("1", "d"), ("2", "e"), ("2", "f"), ("2", "g"), ("2", "h")], "group string, id string")
    by_pairs = scoring.pair_confusion(found, truth, truth, scoring.all_neutral_pairs(link, truth)).first()
    assert scoring.pair_confusion(found, truth, truth, linkage=link).first() == by_pairs and by_pairs.neutral_pair_total > 10
    assert scoring.pair_confusion(found, truth, truth, linkage=link.where("false")).first() == scoring.pair_confusion(found, truth, truth).first()


def test_label_blind_and_all_views(spark, tmp_path):
    """The command line: from tables in a folder to scores, by one view and by four."""
    given = inputs(spark)
    for name in ("transfers", "possible", "seen", "decoded", "bytes_read"):
        given[name].write.parquet(f"file://{tmp_path}/in/{name}.parquet")
    given["sources"][0].write.parquet(f"file://{tmp_path}/in/functions.parquet")
    root = f"file://{tmp_path}/cli"
    assert jobs.main(["discover", root, "--inputs", f"file://{tmp_path}/in", "--entry", "0x1000"]) == 0
    assert jobs.main(["retrieve", root, "--views", "token,cfg,relation,composite", "--top-k", "4"]) == 0
    run = jobs.Run.load(spark, root)
    assert run.told("discovery")["core_sha256"] and set(run.told("retrieval")["queues"]) == {"multi", "consensus2", "consensus3"}
    assert {v for r in run.read("multi").collect() for v in r.views} == {"token", "cfg", "relation", "composite"}
    assert jobs.main(["group", root]) == 0
