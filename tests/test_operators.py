"""Operators on small literal cases."""

import hashlib
import os
import random
import struct
import time
from collections import Counter
from decimal import Decimal
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from kinweave.functions import kernels, names
from kinweave.functions import scalars as S
from kinweave.operators import bodies, discovery, families, graph, grouping, labels, profiles, relaxed, retrieval, scoring, similarity, validate
from kinweave.sources import artifacts, bindings, images, tables
from kinweave.streaming import windows

DECODED = "id string, address long, function_size long, offset long, size long, mnemonic string, operand_text string, operand_kinds array<string>, groups array<string>"


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first().asDict()


def test_scalars(spark):
    lit = F.lit
    got = one(
        spark,
        id_=S.function_id(lit(0x140000000)),
        back=S.address_of_id(lit("FUN_00101100")),
        hex_=S.hex_address(lit(4096)),
        no=S.address_of_id(lit("FUN_1")),
        ints=F.array(*(S.parse_integer(lit(t)) for t in ("0x10", " - 12", "007", "+5", "x", "0", "0xffffffffffffffff"))),
        ops=S.split_operands(lit(" rax , [rbx + 8] ")),
        none=F.size(S.split_operands(lit("  "))),
        widths=F.array(*(S.register_width(lit(t)) for t in ("RAX", "r9d", "al", "xmm3", "ymm0", "k1", "st(2)", "zzz"))),
        rip=F.array(*(S.rip_displacement(lit(t)) for t in ("qword ptr [rip + 0x10]", "[rip - 8]", "[rax]"))),
        shapes=F.array(*(S.operand_shape(lit(t)) for t in ("eax", "reg64", "dword ptr [rsp]", "mem32", "call_target", "-0x1f", "imm_small", "", "odd"))),
        consts=F.array(*(S.constant_shape(lit(t)) for t in ("0", "1", "-255", "256", "abc", "x" * 65))),
        flows=F.array(*(S.control_flow_shape(lit(t)) for t in ("return", "conditional_branch", "indirect_jump", "call", None))),
        owner=F.array(S.owner_from_name(lit("<core::fmt::X>")), S.owner_from_name(lit("foo::core"))),
        jac=S.multiset_jaccard(S.counts(F.array(lit("a"), lit("a"), lit("b"))), S.counts(F.array(lit("a"), lit("c")))),
        empty=S.multiset_jaccard(F.create_map().cast("map<string,bigint>"), F.create_map().cast("map<string,bigint>")),
        sets=S.set_jaccard(F.array(lit(1), lit(2), lit(2)), F.array(lit(2), lit(3))),
        tenths=S.precise_sum([lit(0.1)] * 10),
        grams=S.ngrams(F.array(*(lit(x) for x in "abcd"))),
        short=S.ngrams(F.array(lit("a"), lit("b"))),
        family=S.family_id(F.array(lit("b"), lit("a"))),
        token=S.retrieval_token(lit("MOV"), F.array(lit("reg")), F.array().cast("array<string>"), lit("fallthrough")),
        ratio=F.array(S.ratio(lit(0), lit(0)), S.ratio(lit(1), lit(4))),
    )
    assert got["id_"] == "FUN_140100000" and got["back"] == 0x1100 and got["hex_"] == "0x1000" and got["no"] is None
    assert got["ints"] == [16, -12, None, 5, None, 0, 2**64 - 1]
    assert got["ops"] == ["rax", "[rbx + 8]"] and got["none"] == 0
    assert got["widths"] == [64, 32, 8, 128, 256, 64, 80, None] and got["rip"] == [16, -8, None]
    assert got["shapes"] == ["reg", "reg64", "mem", "mem32", "target", "imm", "imm_small", "unknown", "odd"]
    assert got["consts"] == ["int:zero", "int:one", "int:small", "int:large", "str:1-4", "str:65+"]
    assert got["flows"] == ["return", "conditional", "jump", "call", "fallthrough"] and got["owner"] == ["core", None]
    assert (got["jac"], got["empty"], got["tenths"]) == (0.25, 1.0, 1.0) and abs(got["sets"] - 1 / 3) < 1e-12
    assert got["grams"] == [["a", "b", "c"], ["b", "c", "d"]] and got["short"] == [["a", "b"]]
    assert got["family"] == "family_" + artifacts.digest(["a", "b"]) and got["token"] == "MOV|reg|-|fallthrough" and got["ratio"] == [1.0, 0.25]


def test_policy_is_checked():
    for bad in ({"structure_match": 2}, {"slot_match": "1"}, {"max_cells": -1}, {"max_comparisons": True}, {"structure_reject": 0.99}):
        with pytest.raises(ValueError):
            S.PairPolicy(**bad)


def test_names():
    cases = {
        "core::ptr::drop_in_place<alloc::vec::Vec<u8>>": ("core::ptr::drop_in_place", "core"),
        "foo::bar::<T>::baz::h0123456789abcdef": ("foo::bar::baz", "foo"),
        "a::<impl core::Foo for b::Bar<T>>::run": ("a::impl_for=b::Bar::run", "a"),
        "<a::B<T> as core::Clone>::clone": ("<a::B as core::Clone>::clone", "a"),
        "<core::X as std::Y>::z": ("<core::X as std::Y>::z", "core"),
        "x::<impl y::Z>::q": ("x::impl=y::Z::q", "x"),
        "main": ("main", None),
        "f<g": ("f<g", None),
    }
    assert {n: (names.canonical(n), names.owner(n)) for n in cases} == cases
    r = random.Random(7)
    for _ in range(300):
        # rules on names that are made of parts whose normal form is known
        made = [r.choice([("a", "a"), ("b2", "b2"), ("f<u8>", "f"), ("g<h<T>, U>", "g")]) for _ in range(r.randint(1, 4))]
        turbo, tail = r.choice(["", "::<T>", "::<a::B<C>>"]), r.choice(["", "::h00112233aabbccdd"])
        kind, head = "::".join(x for x, _ in made), "::".join(y for _, y in made)
        assert names.canonical(f"{kind}{turbo}{tail}") == head
        assert names.canonical(f"<{kind} as t::U<V>>::m{turbo}{tail}") == f"<{head} as t::U>::m"
        assert names.canonical(f"x::<impl t::U<V> for {kind}>::m{turbo}{tail}") == f"x::impl_for={head}::m"
        assert names.canonical(f"x::<impl {kind}>::m") == f"x::impl={head}::m"
        plain = "::".join(y for _, y in made)
        assert names.owner(plain) == (made[0][1] if len(made) > 1 else None)
        assert names.owner(f"<std::X as z::Y>::m") == "z" and names.owner("<std::X>::m") == "std"


def decoded(spark, rows, address=0x1000, size=64):
    return spark.createDataFrame([("f", address, size, o, s, m, t, k, g) for o, s, m, t, k, g in rows], DECODED)


def test_normal_instructions(spark):
    rows = [
        (0, 3, "mov", "rax, 5", ["register", "immediate"], []),
        (3, 5, "call", "0x2000", ["immediate"], ["call"]),
        (8, 2, "je", "0x1010", ["immediate"], ["jump"]),
        (10, 2, "jmp", "0x5000", ["immediate"], ["jump"]),
        (12, 2, "jmp", "rax", ["register"], ["jump"]),
        (14, 7, "lea", "rdi, [rip + 0x20]", ["register", "memory"], []),
        (21, 4, "cmp", "dword ptr [rbp - 4], 0x200000", ["memory", "immediate"], []),
        (25, 1, "ret", "", [], ["ret"]),
    ]
    got = {r.offset: r for r in bodies.normalize_instructions(decoded(spark, rows)).collect()}
    assert got[0].operands == ["reg64", "imm_small"] and got[0].constants == [5] and got[0].control_flow == "fallthrough"
    assert got[3].operands == ["call_target"] and got[3].slots[0].status == "address-only" and got[3].constants == []
    assert got[8].control_flow == "conditional_branch" and got[8].branch_target_offset == 16 and got[8].operands == ["local_block_target"]
    assert got[10].control_flow == "external_jump" and got[10].branch_target_offset is None and got[10].operands == ["external_target"]
    assert got[12].control_flow == "indirect_jump" and got[12].operands == ["opaque_target"] and got[12].slots[0].status == "opaque"
    assert got[14].operands == ["reg64", "ip_data_slot64"] and got[14].slots[0].value == f"FUN_{0x1000 + 21 + 0x20 + 0x100000:08x}"
    assert got[21].operands == ["stack32", "imm_address_like"] and got[25].control_flow == "return"


def test_completeness(spark):
    functions = spark.createDataFrame([("ok", 3, 3), ("gap", 4, 4), ("short", 4, 2), ("none", 4, None), ("empty", 0, 0), ("zero", 1, 1)], "id string, size long, bytes_read long")
    ins = spark.createDataFrame([("ok", 0, 1), ("ok", 1, 2), ("gap", 0, 1), ("gap", 2, 2)], "id string, offset long, size long")
    got = {r.id: r.failure_reason for r in bodies.completeness(functions, ins).collect()}
    assert got == {"ok": None, "gap": "decode_gap", "short": "truncated_extent", "none": "extent_not_file_backed", "empty": "extent_not_file_backed", "zero": "zero_instruction_decode"}


INS = "id string, offset long, size long, mnemonic_class string, operands array<string>, control_flow string, branch_target_offset long, constants array<decimal(20,0)>, slots array<struct<kind:string,value:string,status:string,resolver:string>>"


def ins(i, offset, flow="fallthrough", target=None, mnemonic="MOV", operands=(), constants=(), slots=()):
    return (i, offset, 1, mnemonic, list(operands), flow, target, [Decimal(c) for c in constants], list(slots))


def test_blocks_and_edges(spark):
    rows = [ins("f", 0), ins("f", 1, "conditional_branch", 4), ins("f", 2), ins("f", 3, "local_jump", 0), ins("f", 4, "indirect_jump"), ins("f", 5, "external_jump"), ins("f", 6, "conditional_branch", None)]
    table = spark.createDataFrame(rows, INS)
    found = bodies.blocks(table, table.groupBy("id").agg(F.count("*").alias("size"))).cache()
    assert {(r.label, r.start_offset, r.end_offset) for r in found.collect()} == {("B0", 0, 2), ("B1", 2, 4), ("B2", 4, 5), ("B3", 5, 6), ("B4", 6, 7)}
    edges = bodies.cfg_edges(found)
    assert {(r.source, r.target, r.kind) for r in edges.collect()} == {
        ("B0", "B2", "conditional_target"), ("B0", "B1", "fallthrough"), ("B1", "B0", "direct_jump"), ("B2", "OPAQUE", "opaque_successor"), ("B3", "EXIT", "external_exit"), ("B4", "EXIT", "conditional_target"), ("B4", "EXIT", "fallthrough"),
    }
    assert bodies.opaque_jumps(found).first().opaque_indirect_jumps == 1
    assert profiles.cfg_features(found, edges).where("kind = 3").agg(F.sum("n")).first()[0] == 5


def random_bodies(spark, n=6, seed=3):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        for o in range(r.randint(1, 14)):
            flow = r.choice(["fallthrough", "fallthrough", "call", "conditional_branch", "local_jump", "return"])
            slots = [("data", r.choice(["x", "y"]), None, None)] if r.random() < 0.3 else []
            rows.append(ins(f"b{k}", o, flow, r.randint(0, 12) if flow in ("conditional_branch", "local_jump") else None, r.choice(["MOV", "ADD", "LEA"]), r.choice([["reg64"], ["reg32", "imm_small"]]), r.choice([[], [1], [2, 300]]), slots))
    table = spark.createDataFrame(rows, INS)
    sizes = table.groupBy("id").agg(F.count("*").alias("size"))
    found = bodies.blocks(table, sizes).cache()
    edges = bodies.cfg_edges(found)
    quality = sizes.select("id", F.lit(True).alias("complete_decode"), F.lit(0).alias("opaque_indirect_jumps"))
    return table, sizes, found, edges, bodies.assemble(sizes, table, found, edges, quality).cache()


def plain_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_kernels():
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.choice("abc") for _ in range(r.randint(0, 9))] for _ in range(2))
        assert kernels.lcs_length(a, b) == len(kernels.lcs_pairs(a, b)) == plain_lcs(a, b)
    assert kernels.lcs_pairs(["PUSH", "MOV", "RET"], ["PUSH", "MOV", "LEA", "RET"]) == [(0, 0), (1, 1), (2, 3)]
    assert kernels.lcs_pairs(["M", "M", "M", "R"], ["M", "M", "R"]) == [(0, 0), (1, 1), (3, 2)]
    assert kernels.sequence_ratio([], []) == kernels.matching_blocks_ratio([], []) == 1.0


def test_pair_metrics(spark):
    *_, whole = random_bodies(spark)
    pairs = spark.createDataFrame(list(combinations([f"b{k}" for k in range(6)], 2)) + [("b0", "b0")], "first string, second string")
    got = {(r.first, r.second): r for r in similarity.metrics(pairs, whole).collect()}
    same = got["b0", "b0"]
    assert same.sequence_ratio == same.aligned_instruction_ratio == same.edge_consistency == same.aligned_block_ratio == 1.0
    records = {r.id: r.asDict(True) for r in whole.collect()}
    for (a, b), m in got.items():
        ta, tb = ([" ".join([x["mnemonic_class"], *x["operands"]]) for x in records[i]["instructions"]] for i in (a, b))
        assert m.sequence_ratio == pytest.approx(plain_lcs(ta, tb) / max(len(ta), len(tb)))
        ca, cb = (Counter(x["mnemonic_class"] for x in records[i]["instructions"]) for i in (a, b))
        assert m.mnemonic_multiset_jaccard == pytest.approx((ca & cb).total() / (ca | cb).total())
        assert 0 <= m.aligned_instruction_ratio <= 1 and m.matched_block_count <= m.candidate_block_pair_count
    aligned = similarity.alignments(pairs, whole).where("first = 'b0' AND second = 'b0'").first()
    assert [(p.first, p.second) for p in aligned.instruction_pairs] == [(i, i) for i in range(len(records["b0"]["instructions"]))]
    lists = spark.createDataFrame([(["a", "b"], ["b"]), (None, None)], "a array<string>, b array<string>")
    assert [(r.lcs_ratio, round(r.matching_blocks_ratio, 4)) for r in similarity.sequence_ratios(lists).collect()] == [(0.5, 0.6667), (1.0, 1.0)]


def plain_jaccard(a, b):
    return (a & b).total() / (a | b).total() if a | b else 1.0


def test_top_k_against_all_pairs(spark):
    table, sizes, found, edges, _ = random_bodies(spark, 12)
    extra = table.where("id = 'b3'").withColumn("id", F.lit("b3copy"))
    table = table.unionByName(extra)
    sizes = table.groupBy("id").agg(F.count("*").alias("size"))
    features = profiles.token_features(table).cache()
    rows = profiles.token_profiles(sizes, features)
    plain = {}
    for r in features.collect():
        plain.setdefault(r.id, [Counter() for _ in range(4)])[r.kind][r.key] = r.n
    want = []
    for a in plain:
        near = sorted(((-round(sum(plain_jaccard(x, y) for x, y in zip(plain[a], plain[b], strict=True)) / 4, 9), b) for b in plain if b != a))
        want += [(a, b, -s, k + 1) for k, (s, b) in enumerate(near[:3]) if s < 0]
    for block in (128, 3):  # blocks of three are many cells, some of which bounds leave out
        got = retrieval.top_k(rows, retrieval.TOKEN, 3, digits=9, block=block).collect()
        assert sorted((r.source, r.target, r.score, r["rank"]) for r in got) == sorted(want)


def test_search_in_parts_and_views(spark):
    table, *_ = random_bodies(spark, 6)
    table = table.unionByName(table.where("id = 'b3'").withColumn("id", F.lit("b3copy")))
    sizes = table.groupBy("id").agg(F.count("*").alias("size"))
    rows = profiles.token_profiles(sizes, profiles.token_features(table).cache()).cache()
    parts = rows.withColumn("part", F.when(F.col("id") < "b2", "x").otherwise("y"))
    inside = retrieval.top_k(parts, retrieval.TOKEN, 3, part="part").collect()
    assert all((r.source < "b2") == (r.target < "b2") for r in inside)
    found = bodies.blocks(table, sizes).cache()
    edges = bodies.cfg_edges(found)
    cfg = retrieval.top_k(profiles.cfg_profiles(sizes, found, edges, profiles.cfg_features(found, edges)), retrieval.CFG, 2)
    twin = [r for r in cfg.collect() if r.source == "b3" and r["rank"] == 1]
    assert twin[0].target == "b3copy" and twin[0].score == 1.0
    groups = spark.createDataFrame([(0, "b1", "C1"), (0, "b2", "C1"), (0, "b3", "C2"), (1, "b1", "C1"), (1, "b2", "C2")], "round int, id string, cluster string")
    legacy = retrieval.legacy_candidates(retrieval.top_k(rows, retrieval.TOKEN, 1), retrieval.within_groups(rows, groups, retrieval.TOKEN, 2), profiles.token_hashes(table).withColumnRenamed("exact_token_hash", "exact_hash"))
    by_pair = {(r.first, r.second): r for r in legacy.collect()}
    assert by_pair["b1", "b2"].last_shared_round == 0 and "same_exact_hash" in by_pair["b3", "b3copy"].reasons
    with pytest.raises(ValueError):
        retrieval.top_k(rows, retrieval.TOKEN, 0)


def test_union_consensus_annotations(spark):
    s = "view string, source string, target string, score double, rank int"
    both = retrieval.unite(spark.createDataFrame([("token", "a", "b", 0.5, 2), ("token", "b", "a", 0.5, 1), ("token", "a", "c", 0.4, 3)], s), spark.createDataFrame([("cfg", "b", "a", 0.9, 1)], s))
    got = {(r.first, r.second): r for r in both.collect()}
    assert got["a", "b"].views["token"]["rank"] == 1 and got["a", "b"].reasons == ["cfg_top_k", "token_top_k"]
    assert [(r.first, r.second) for r in retrieval.consensus(both, 2).collect()] == [("a", "b")]
    groups = spark.createDataFrame([(0, "a", "C1"), (0, "b", "C1"), (0, "c", "C2"), (1, "a", "C1"), (1, "b", "C2")], "round int, id string, cluster string")
    sigs = spark.createDataFrame([("a", [("x", 1)], None), ("b", [("x", 1)], None)], "id string, out_signature array<struct<d:string,n:int>>, in_signature array<struct<d:string,n:int>>")
    notes = {(r.first, r.second): r for r in retrieval.annotate(both, groups, sigs, 1).collect()}
    ab, ac = notes["a", "b"], notes["a", "c"]
    assert (ab.same_final_colour, ab.same_prior_colour, ab.last_shared_round, ab.same_out_signature, ab.same_in_signature) == (False, True, 0, True, None)
    assert (ac.same_final_colour, ac.same_prior_colour, ac.last_shared_round, ac.same_out_signature) == (None, False, None, None)
    faults = validate.candidate_faults(both, spark.createDataFrame([("a",), ("b",)], "id string"), ("token",), 1)
    assert {(r.first, r.second): r.fault for r in faults.collect()} == {("a", "b"): "unknown view", ("a", "c"): "outside the universe"}


def test_discovery(spark):
    f = "address long, size long, name string, boundary_source string, kind string"
    a = spark.createDataFrame([(1, 0, "x", "r2", "fcn"), (2, 5, "y", "r2", "fcn")], f)
    b = spark.createDataFrame([(1, 7, "x2", "angr", "fcn"), (2, 9, "y2", "angr+r2", "fcn"), (3, 4, "z", "angr", "fcn")], f)
    got = {r.address: (r.size, r.name, r.boundary_source) for r in discovery.merge_sources(a, b).collect()}
    assert got == {1: (7, "x", "r2+angr"), 2: (5, "y", "r2+angr"), 3: (4, "z", "angr")}
    spans = spark.createDataFrame([(0, 100000), (10, 5), (12, 5), (50, 0)], "start long, size long")
    points = spark.createDataFrame([(p,) for p in (10, 13, 17, 50, 99999, 100000, 13)], "p long")
    located = sorted((r.p, r.start) for r in discovery.locate(points, spans, "p", "start", "size", ["start"], bucket=4).fillna(-1).collect())
    assert located == [(10, 10), (13, 0), (13, 0), (17, 0), (50, 50), (99999, 0), (100000, -1)]
    ordered = spans.withColumn("seq", F.when(F.col("start") == 12, 0).when(F.col("start") == 10, 1).otherwise(2))
    assert sorted((r.p, r.start) for r in discovery.locate(points, ordered, "p", "start", "size", ["start"], bucket=4, order="seq").fillna(-1).collect()) == [(10, 10), (13, 12), (13, 12), (17, 0), (50, 50), (99999, 0), (100000, -1)]
    t = spark.createDataFrame([(1, 5, 0, 2, "immediate"), (1, 5, 1, None, "register"), (1, 6, 2, None, "memory"), (2, 7, 3, 9, "immediate"), (3, 8, 4, None, "register"), (3, 9, 5, None, "memory")], "source long, callsite long, seq long, target long, operand_kind string").withColumn("resolver", F.lit(None).cast("string"))
    c = discovery.classify_targets(discovery.latest_per_site(t, "seq"), a)
    r = discovery.resolve_indirect(c, spark.createDataFrame([(1, 5, 2), (1, 6, 2), (1, 6, 3)], "source long, callsite long, target long"), spark.createDataFrame([(3, 8)], "source long, callsite long"))
    assert {(x.source, x.callsite): (x.status, x.target, x.resolution) for x in r.collect()} == {(1, 5): ("resolved", 2, "resolved-singleton"), (1, 6): ("unresolved", None, "multiple-targets"), (2, 7): ("unmapped", 9, None), (3, 8): ("unresolved", None, "unresolvable-target"), (3, 9): ("unresolved", None, "not-seen")}
    assert discovery.resolution_summary(r).first().resolution_rate == 0.25
    nodes, edges = discovery.call_graph(a, r)
    assert {x.address for x in nodes.collect()} == {1, 2, 9} and {(x.src, x.dst, x["count"]) for x in edges.collect()} == {(1, 2, 1), (2, 9, 1)}
    classified = discovery.classify(nodes, spark.createDataFrame([(2, False)], "address long, complete_decode boolean"), 1)
    assert {x.address: (x.role, x.colour) for x in classified.collect()} == {1: ("context-only", "root"), 2: ("abstain", None), 9: ("context-only", "opaque:9")}
    assert discovery.abstentions(classified).count() == 1 and discovery.choose_root(a, 4) == 2
    status = discovery.relation_status(spark.createDataFrame([("a", "member"), ("b", "member"), ("c", "abstain"), ("d", "context-only")], "id string, role string"), spark.createDataFrame([("a", "d", 1), ("b", "b", 2)], "src string, dst string, count long"))
    assert {x.id: x.relation_status for x in status.collect()} == {"a": "member", "b": "abstain", "c": "abstain", "d": "context"}


def plain_refine(nodes, edges):
    """Partitions of each round, by strings."""
    out = {n: [(d, c) for s, d, c in edges if s == n and d != n and d in nodes] for n in nodes}
    inn = {n: [(s, c) for s, d, c in edges if d == n and s != n and s in nodes] for n in nodes}
    self_ = {n: sum(c for s, d, c in edges if s == d == n) for n in nodes}
    colour = {n: f"m{self_[n]}:{len(out[n])}" if nodes[n] is None else f"a{nodes[n]}" for n in nodes}
    rounds = [dict(colour)]
    while True:
        def bag(items):
            c = Counter()
            for other, k in items:
                c[colour[other]] += k
            return tuple(sorted(c.items()))
        new = {n: repr((colour[n], bag(out[n]), () if out[n] else bag(inn[n]))) for n in nodes}
        ids = {v: str(i) for i, v in enumerate(sorted(set(new.values())))}
        same = len(set(new.values())) == len(set(colour.values()))
        colour = {n: ids[v] for n, v in new.items()}
        rounds.append(dict(colour))
        if same:
            return rounds


def test_refinement(spark):
    r = random.Random(4)
    nodes = {f"n{i}": (None if i < 20 else f"x{i % 2}") for i in range(24)}
    edges = sorted({(f"n{r.randint(0, 19)}", f"n{r.randint(0, 23)}"): r.randint(1, 2) for _ in range(30)}.items())
    edges = [(s, d, c) for (s, d), c in edges]
    table = spark.createDataFrame([(n, a is None, a) for n, a in nodes.items()], "id string, is_member boolean, anchor string")
    colours = graph.refine(table, spark.createDataFrame(edges, "src string, dst string, count long"))
    got = {}
    for x in colours.collect():
        got.setdefault(x.round, {}).setdefault(x.colour, set()).add(x.id)
    want = plain_refine(nodes, edges)
    assert len(got) == len(want)
    for k, w in enumerate(want):
        groups = {}
        for n, c in w.items():
            groups.setdefault(c, set()).add(n)
        assert sorted(map(sorted, got[k].values())) == sorted(map(sorted, groups.values()))
    first = {x.cluster: x.id for x in graph.clusters(colours).where("round = 0").orderBy(F.desc("id")).collect()}
    assert first["C1"] == "n0"
    two = graph.clusters(graph.refine(spark.createDataFrame([("r", False, "root"), ("a", True, None), ("b", True, None)], "id string, is_member boolean, anchor string"), spark.createDataFrame([("r", "a", 1), ("r", "b", 1), ("a", "r", 1), ("b", "r", 1)], "src string, dst string, count long")))
    assert {x.cluster for x in two.collect()} == {"C1"}


def test_costs_and_admission(spark):
    members = spark.createDataFrame([("a1", "a"), ("a2", "a"), ("a3", "a"), ("b1", "b"), ("b2", "b"), ("o1", "o1"), ("x1", "x1")], "id string, component string")
    lengths = spark.createDataFrame([("a1", 2), ("a2", 3), ("a3", 4), ("b1", 5), ("b2", 6)], "id string, n long")
    costs = grouping.component_costs(members, lengths).cache()
    assert {r.component: (r.comparisons, r.cells) for r in costs.collect()} == {"a": (3, 26), "b": (1, 30), "o1": (0, 0), "x1": (0, 0)}
    admitted = grouping.admit(costs, S.PairPolicy(max_comparisons=4, max_cells=50))
    assert {r.component: r.selected for r in admitted.collect()} == {"a": True, "b": False, "o1": True, "x1": True}
    # a component that needs too many comparisons is passed over, a later one fits
    many = spark.createDataFrame([("p", 3, 3, 5, 1), ("q", 2, 2, 2, 9)], "component string, n_members long, n_comparable long, comparisons long, cells long")
    assert {r.component: r.selected for r in grouping.admit(many, S.PairPolicy(max_comparisons=2, max_cells=50)).collect()} == {"p": False, "q": True}
    pairs = spark.createDataFrame([("a1", "a2"), ("b1", "b2"), ("a1", "z")], "first string, second string")
    assert {(r.first, r.second) for r in grouping.budgeted(pairs, members, admitted).collect()} == {("a1", "a2")}
    s = grouping.cost_summary(pairs, lengths).first()
    assert (s.pair_count, s.alignment_cells, s.alignment_cells_max, s.alignment_cells_median, s.alignment_cells_p99) == (3, 36, 30, 6, 30)
    p = grouping.price(pairs, lengths, lengths.select("id"), S.PairPolicy(max_comparisons=1)).first()
    assert (p.required_comparisons, p.required_alignment_cells, p.cells_median, p.top10_share, p.within_budget) == (2, 36, 30, 1.0, False)
    empty = grouping.cost_summary(pairs.where("false"), lengths).first()
    assert (empty.pair_count, empty.alignment_cells, empty.alignment_cells_median) == (0, 0, 0)


def test_decisions(spark):
    rows = [(1.0, 1.0, None, True, 0, "match"), (1.0, None, None, True, 0, "unknown"), (0.1, 1.0, 1.0, True, 0, "reject"), (1.0, 1.0, 0.5, True, 0, "unknown"), (1.0, 1.0, 1.0, False, 0, "abstain"), (1.0, 1.0, 1.0, True, 2, "abstain")]
    table = spark.createDataFrame(rows, "structure_score double, constant_similarity double, data_reference_similarity double, both_complete boolean, opaque_indirect_jumps int, want string")
    policy = S.PairPolicy(structure_reject=0.2)
    out = grouping.decide(table, policy).collect()
    assert all(r.decision == r.want == grouping._verdict(r.asDict(), policy) for r in out)
    assert out[1].margin == float("-inf") and out[3].margin == -0.5


def test_complete_link(spark):
    # a-b and b-c match, a-c is no candidate and doesn't: the better edge wins
    def body(i, constants):
        return [ins(i, 0, constants=constants), ins(i, 1, "return", mnemonic="RET")]

    table = spark.createDataFrame([x for i, c in (("a", [1]), ("b", [1]), ("c", [2]), ("d", [9]), ("e", [9])) for x in body(i, c)], INS)
    sizes = table.groupBy("id").agg(F.count("*").alias("size"))
    found = bodies.blocks(table, sizes)
    quality = sizes.select("id", (F.col("id") != "e").alias("complete_decode"), F.lit(0).alias("opaque_indirect_jumps"))
    whole = bodies.assemble(sizes, table, found, bodies.cfg_edges(found), quality).cache()
    dec = spark.createDataFrame([("a", "b", "match", 0.5, 1.0), ("b", "c", "match", 0.1, 1.0), ("c", "d", "unknown", 0.0, 1.0)], "first string, second string, decision string, margin double, structure_score double")
    policy = S.PairPolicy()
    members, made, blocked = grouping.complete_link(dec, whole, policy)
    assert {r.id: r.least for r in members.collect()} == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "e"}
    assert {(r.first, r.second, r.source) for r in made.collect()} >= {("a", "c", "on-demand")}
    assert [(r.first, r.second) for r in blocked.collect()] == [("b", "c")]
    status = grouping.family_status(members, made, whole, policy).cache()
    assert {r.id: r.status for r in status.collect()} == {"a": "accepted", "b": "accepted", "c": "provisional", "d": "unresolved", "e": "abstain"}
    assert validate.family_faults(status, whole.select("id")).count() == 0 and validate.decision_faults(made).count() == 0
    assert {r.status: r.members for r in grouping.summary(status).collect()}["accepted"] == 2
    refused = grouping.strict_families(dec.select("first", "second"), whole, S.PairPolicy(max_comparisons=1), similarity.features)
    assert refused[0] == "budget-refused" and refused[1] is None


def plain_complete_link(edges, lengths, known, verdict, most):
    """(groups, blocked merges) by one walk over all edges, charging each pair that is compared on demand."""
    cluster, known, left, blocked = {i: {i} for i in lengths}, dict(known), list(most), []
    for a, b in edges:
        if cluster[a] is cluster[b]:
            continue
        across = [tuple(sorted((x, y))) for x in cluster[a] for y in cluster[b]]
        new = [p for p in across if p not in known]
        need = (len(new), sum(lengths[x] * lengths[y] for x, y in new))
        if any(n > m for n, m in zip(need, left, strict=True)):
            blocked.append((a, b, "comparison_budget"))
            continue
        left = [m - n for n, m in zip(need, left, strict=True)]
        known |= {p: verdict(p) for p in new}
        if all(known[p] == "match" for p in across):
            both = cluster[a] | cluster[b]
            cluster |= dict.fromkeys(both, both)
        else:
            blocked.append((a, b, "cross_pair_mismatch"))
    return {i: min(c) for i, c in cluster.items()}, sorted(blocked)


def test_complete_link_charges_a_budget(spark):
    r = random.Random(5)
    lengths = {f"{c}{k}": r.randint(1, 6) for c in "pqrs" for k in range(7)}
    table = spark.createDataFrame([ins(i, o) for i, n in lengths.items() for o in range(n)], INS)
    sizes = table.groupBy("id").agg(F.count("*").alias("size"))
    found = bodies.blocks(table, sizes)
    quality = sizes.select("id", F.lit(True).alias("complete_decode"), F.lit(0).alias("opaque_indirect_jumps"))
    whole = bodies.assemble(sizes, table, found, bodies.cfg_edges(found), quality).cache()
    rows = [(a, b, r.choice(["match", "match", "unknown"]), round(r.random(), 3), 1.0) for a, b in combinations(sorted(lengths), 2) if a[0] == b[0] and r.random() < 0.45]
    dec = spark.createDataFrame(rows, "first string, second string, decision string, margin double, structure_score double").cache()

    def verdict(pair):
        return "match" if int(hashlib.md5("".join(pair).encode()).hexdigest(), 16) % 5 else "unknown"

    def kernel(a, b):
        good = verdict((a.id, b.id)) == "match"
        return {"structure_score": 1.0 if good else 0.0, "constant_similarity": 1.0, "data_reference_similarity": None, "both_complete": True, "opaque_indirect_jumps": 0}

    edges = [(a, b) for a, b, d, m, s in sorted(rows, key=lambda x: (-x[3], x[0], x[1])) if d == "match"]
    known = {(a, b): d for a, b, d, *_ in rows}
    kinds = set()
    for most in ((8, None), (13, 130)):
        policy = S.PairPolicy(max_comparisons=most[0], max_cells=most[1])
        members, _, blocked = grouping.complete_link(dec, whole, policy, kernel)
        limits = tuple(float("inf") if m is None else m for m in most)
        want = plain_complete_link(edges, lengths, known, verdict, limits)
        got = {x.id: x.least for x in members.collect()}, sorted((x.first, x.second, x.reason) for x in blocked.collect())
        assert got == want
        kinds |= {k for *_, k in want[1]}
    assert kinds == {"comparison_budget", "cross_pair_mismatch"}


def filled(spark, cases):
    """cases: family -> member -> values of slots at offsets 0, 1, ..."""
    flat = [(f, o, 0, "CALL_TARGET", f"{f}.{m}", v, "missing" if v is None else "resolved") for f, rows in cases.items() for m, values in rows.items() for o, v in enumerate(values)]
    return spark.createDataFrame(flat, "family string, offset int, index int, kind string, id string, value string, state string")


def axis_parts(table):
    found = families.axes(table).cache()
    finer = families.refinements(found)
    covered = families.coverage(found)
    top = families.maximal(found, finer)
    return found, covered, top, families.basis(found, covered, finer, top)


def test_rescue(spark):
    grid = {f"M{3 * i + j}": [f"a{i}", f"b{j}"] for i in range(2) for j in range(3)}
    split = {"L": ["M0", "M3", "M1"], "R": ["M4", "M2", "M5"]}
    sides = {f"{s}{v}": [s, v] for s in "LR" for v in "01"}
    cases = {
        "good": (grid, split, "accepted", None),
        "apart": (grid, split, "rejected", "no_relation_bridge"),
        "hole": ({k: v for k, v in grid.items() if k != "M5"}, split, "rejected", "basis_not_complete"),
        "short": ({"x": ["a"], "y": ["b"]}, {"L": ["x"], "R": ["y"]}, "rejected", "too_few_independent_axes"),
        "sides": (sides, {"L": ["L0", "L1"], "R": ["R0", "R1"]}, "rejected", "axis_without_internal_fragment_support"),
        "more": ({m: [*v, v[0], "same", None if m == "M0" else "z"] for m, v in grid.items()}, split, "accepted", None),
    }
    table = filled(spark, {f: rows for f, (rows, *_) in cases.items()}).cache()
    found, covered, top, chosen = axis_parts(table)
    frag = spark.createDataFrame([(f"{f}.{m}", k) for f, (_, parts, *_) in cases.items() for k, ms in parts.items() for m in ms], "id string, fragment string")
    comp = spark.createDataFrame([(f,) for f in cases], "component string")
    bridges = spark.createDataFrame([(f, "x", "y") for f in cases if f != "apart"], "component string, first string, second string")
    rows = families.rescue_reasons(comp, bridges, found, covered, top, chosen, families.internal_support(found, frag)).collect()
    assert {r.component: (r.status, r.reason) for r in rows} == {f: (status, why) for f, (*_, status, why) in cases.items()}
    more = found.where("family = 'more'")
    assert {r.n_slots for r in more.where("axis = 1").collect()} == {2} and top.where("family = 'more'").count() == 2
    assert chosen.where("family = 'more'").first().status == "unique" and covered.where("family = 'more'").first().bijective
    report = {r.family: r for r in families.axis_report(table).collect()}
    assert (report["good"].n_slots, report["good"].varying, report["more"].n_slots) == (2, 2, 5)
    assert {r.offset: r.reason for r in families.excluded_slots(table).where("family = 'more'").collect()} == {3: "invariant", 4: "not_resolved_for_every_member"}


def test_rescue_components_and_partition(spark):
    fam = spark.createDataFrame([("a", "F1", "accepted"), ("b", "F1", "accepted"), ("c", "F2", "accepted"), ("d", "F2", "accepted"), ("e", "F3", "accepted"), ("g", "F3", "accepted"), ("h", "F4", "provisional")], "id string, family_id string, status string")
    fragments = families.fragments_of(fam)
    pairs = spark.createDataFrame([("a", "c", True), ("b", "d", None), ("a", "h", True), ("a", "b", True)], "first string, second string, same_prior_colour boolean")
    comp, bridges = families.rescue_components(fragments, pairs)
    assert {(r.fragment, r.component) for r in comp.collect()} == {("F1", "F1"), ("F2", "F1")} and [(r.first, r.second) for r in bridges.collect()] == [("a", "c")]
    final = families.final_partition(fragments, comp, spark.createDataFrame([("F1", "accepted")], "component string, status string"))
    assert {(r.family_id, r.origin) for r in final.collect()} == {("F1+F2", "rescued"), ("F3", "strict")}
    costs = families.reserve(spark.createDataFrame([("F1", "a"), ("F1", "b"), ("F1", "c")], "component string, id string"), spark.createDataFrame([("a", 2), ("b", 3), ("c", 4)], "id string, n long"))
    assert costs.first().asDict() == {"component": "F1", "n_members": 3, "comparisons": 5, "cells": 26 + 20}
    verdict = spark.createDataFrame([("F1", "accepted", None)], "component string, status string, reason string")
    assert families.rescue(comp.select("component").distinct(), costs, verdict, max_members=2).first().reason == "too_many_members"
    assert families.rescue(comp.select("component").distinct(), costs, verdict, max_cells=3).first().reason == "over_budget"
    assert families.rescue(comp.select("component").distinct(), costs, verdict).first().status == "accepted"
    assert {r.id: r.fault for r in validate.partition_faults(final.where("id <> 'e'"), fragments.withColumnRenamed("fragment", "family_id")).collect()} == {"e": "missing"}


def test_slots_and_template(spark):
    rows = [ins("m", 0, "call"), ins("m", 1, "external_jump"), ins("m", 2, "indirect_jump"), ins("m", 3, constants=[7], slots=[("data", "D", None, None)]), ins("n", 0, "call"), ins("n", 4, constants=[8])]
    functions = spark.createDataFrame([("m", 100), ("n", 200)], "id string, address long")
    t = spark.createDataFrame([(100, 100, "call", "resolved", "T", 1), (100, 102, "tail-call", "filtered", "U", 0), (200, 200, "call", "resolved", "V", 2)], "source long, callsite long, kind string, status string, target string, n_targets int")
    seen = families.slots(spark.createDataFrame(rows, INS), functions, t).cache()
    got = {(r.id, r.offset, r["index"]): (r.kind, r.value, r.state) for r in seen.collect()}
    assert got == {
        ("m", 0, 0): ("CALL_TARGET", "T", "resolved"), ("m", 1, 0): ("TAIL_CALL_TARGET", None, "missing"), ("m", 2, 0): ("TAIL_CALL_TARGET", "U", "filtered"), ("m", 3, 1): ("DATA_REFERENCE", "D", "resolved"),
        ("m", 3, 2): ("IMMEDIATE_CONSTANT", "7", "resolved"), ("n", 0, 0): ("CALL_TARGET", None, "ambiguous"), ("n", 4, 1): ("IMMEDIATE_CONSTANT", "8", "resolved"),
    }
    scores = spark.createDataFrame([("F", "m", "n", 0.5)], "family string, first string, second string, score double")
    medoid = families.medoids(scores).cache()
    assert (medoid.first().medoid, medoid.first().mean_similarity) == ("m", 0.5)
    members = spark.createDataFrame([("F", "m"), ("F", "n")], "family string, id string")
    aligned = spark.createDataFrame([("F", "n", 0, 0)], "family string, id string, medoid_offset long, member_offset long")
    shape = {(r.offset, r["index"], r.id): (r.value, r.state) for r in families.template(members, medoid, seen, aligned).collect()}
    assert shape[0, 0, "m"] == ("T", "resolved") and shape[0, 0, "n"] == (None, "ambiguous") and shape[3, 2, "n"] == (None, "missing")
    blocks = spark.createDataFrame([("m", "B0"), ("m", "B1"), ("n", "B0"), ("n", "B9")], "id string, label string")
    matched = spark.createDataFrame([("F", "n", "B0")], "family string, id string, label string")
    assert {r.label: r.role for r in families.block_roles(members, medoid, blocks, matched).collect()} == {"B0": "common", "B1": "optional"}
    assert [r.label for r in families.orphan_blocks(members, medoid, blocks, matched).collect()] == ["B9"]
    with pytest.raises(Exception, match="duplicate callsite"):
        families.unique_sites(t.union(t)).collect()


def test_propagation(spark):
    raw = spark.createDataFrame([(1, None, "a::f::<T>", "direct-flirt"), (2, 9, "b::g", "propagated-wrapper"), (7, None, "a::f", "direct-flirt")], "address long, mapped_address long, name string, evidence string")
    functions = spark.createDataFrame([(1,), (2,)], "address long")
    found = labels.bucket_labels(raw, functions).cache()
    assert {r.address: (r.bucket, r.canonical_origin, r.owner, r.seedable) for r in found.collect()} == {1: ("matches", "a::f", "a", True), 2: ("propagated_wrappers", "b::g", "b", False), 7: ("unmatched_addresses", "a::f", "a", True)}
    assert validate.label_faults(found).count() == 0
    seed = labels.seeds(found).cache()
    ids = {r.address: r.member for r in seed.collect()}
    assert set(ids) == {1, 7}
    partition = spark.createDataFrame([("P", ids[1]), ("P", "other"), ("Q", "lone"), ("Q", "lone2")], "family_id string, id string")
    direct, fams, given = labels.propagate(partition, seed, partition.select("id"))
    assert {r.member: r.in_universe for r in direct.collect()} == {ids[1]: True, ids[7]: False}
    assert {r.family_id: r.status for r in fams.collect()} == {"P": "eligible", "Q": "no-seed"} and [(r.member, r.canonical_origin) for r in given.collect()] == [("other", "a::f")]
    o = labels.opportunity(direct, fams, given, partition, partition.select("id")).first()
    assert (o.direct_seed_count, o.outside_universe_count, o.propagated_member_count, o.eligible_family_count) == (2, 1, 1, 1)


def test_attachment(spark):
    cores = spark.createDataFrame([("K1", "k1"), ("K1", "k2"), ("K2", "k3"), ("K2", "k4")], "family_id string, id string")
    singles = spark.createDataFrame([("s",), ("t",), ("u",), ("v",)], "id string")
    d = [("k1", "s", "match", "candidate"), ("k2", "s", "unknown", "on-demand"), ("k1", "t", "match", "candidate"), ("k3", "t", "match", "candidate"), ("k1", "u", "match", "on-demand"), ("k1", "v", "match", "candidate"), ("k2", "v", "reject", "on-demand")]
    dec = spark.createDataFrame(d, "first string, second string, decision string, source string")
    got = {r.id: r for r in labels.attach(dec, singles, cores).collect()}
    assert (got["s"].outcome, got["s"].family_id, got["s"].n_unknown, got["s"].n_missing) == ("attached", "K1", 1, 0)
    assert got["t"].outcome == "ambiguous" and got["t"].families == ["K1", "K2"]
    assert got["u"].outcome == got["v"].outcome == "unassigned"
    assert [(r.member, r.family_id) for r in labels.vetoes(dec, singles, cores).collect()] == [("v", "K1")]
    reach = labels.cross_pairs(spark.createDataFrame([("k1", "s")], "first string, second string"), singles, cores)
    assert {(r.first, r.second) for r in reach.collect()} == {("k1", "s"), ("k2", "s")}
    groups = labels.scoring_groups(cores, labels.attach(dec, singles, cores))
    assert {r.group for r in groups.collect()} == {"K1", "K2", "K1+s"}


def test_scores(spark):
    truth = spark.createDataFrame([("o1", "a"), ("o1", "b"), ("o1", "c"), ("o2", "d"), ("o2", "e")], "origin string, id string")
    predicted = spark.createDataFrame([("g1", "a"), ("g1", "b"), ("g1", "d"), ("g2", "e")], "group string, id string")
    neutral = spark.createDataFrame([("a", "b", "duplicate"), ("a", "e", "ambiguous")], "first string, second string, label string")
    for n, want in ((None, (1, 2, 3, 4)), (neutral, (0, 2, 3, 3))):
        row = scoring.pair_confusion(predicted, truth, truth.select("id"), n).first()
        assert (row.true_positive, row.false_positive, row.false_negative, row.true_negative) == want
        plain = scoring.pair_sets(scoring.overlapping_pairs(predicted), scoring.overlapping_pairs(truth.withColumnRenamed("origin", "group")), 5, n).first()
        assert (plain.true_positive, plain.false_positive, plain.false_negative, plain.true_negative) == want
        assert plain.precision == row.precision and plain.f1 == row.f1
    none = scoring.pair_confusion(predicted.where("false"), truth, truth.select("id")).first()
    assert none.precision is None and none.recall == 0.0 and none.f1 is None
    both = scoring.methods(x=scoring.pair_confusion(predicted, truth, truth.select("id")), y=scoring.pair_confusion(predicted, truth, truth.select("id")))
    total = {r.method: r.true_positive for r in scoring.micro(both.unionByName(both)).collect()}
    assert total == {"x": 2, "y": 2}
    link = spark.createDataFrame([("a", ["i"], ["o"]), ("b", ["i"], ["o"]), ("c", ["j"], ["o", "p"]), ("d", [], ["o"])], "id string, identities array<string>, origins array<string>")
    assert {(r.first, r.second, r.label) for r in scoring.all_neutral_pairs(link, link).collect()} == {("a", "b", "duplicate"), ("a", "c", "ambiguous"), ("b", "c", "ambiguous"), ("a", "d", "unresolved"), ("b", "d", "unresolved"), ("c", "d", "unresolved")}
    a, b = link.select(*(F.col(c).alias(f"l_{c}") for c in link.columns)), link.select(*(F.col(c).alias(f"r_{c}") for c in link.columns))
    rows = a.join(b, F.col("l_id") < F.col("r_id")).select("l_id", "r_id", S.neutral_label(F.col("l_identities"), F.col("l_origins"), F.col("r_identities"), F.col("r_origins")).alias("label"))
    assert {(r.l_id, r.r_id): r.label for r in rows.collect()}["a", "b"] == "duplicate"
    d = scoring.discovery(truth.select("id"), spark.createDataFrame([("a", "complete"), ("b", "incomplete")], "id string, analysis_status string"), spark.createDataFrame([("a", True, None), ("b", False, "decode_gap")], "id string, complete_decode boolean, failure_reason string")).first()
    assert (d.known_count, d.discovered_count, d.missed_count, d.failed_decode_count, d.complete_body_coverage) == (5, 2, 3, 1, 0.2)
    lab = spark.createDataFrame([("a", "foo"), ("b", "bar"), ("z", "foo")], "member string, canonical_origin string")
    sym = spark.createDataFrame([("a", ["x::foo"]), ("b", ["x::foo"])], "member string, names array<string>")
    assert {r.member: r.verdict for r in scoring.label_verdicts(lab, sym).collect()} == {"a": "correct", "b": "incorrect", "z": "unknown"}
    cat = spark.createDataFrame([(1, "f", "w"), (2, "f", "w"), (3, "g", "w")], "address long, origin string, owner string")
    got = spark.createDataFrame([(1, "f", "w"), (3, "h", "w"), (9, "f", "w")], "address long, canonical_origin string, owner string")
    s = scoring.catalog_scores(cat, spark.createDataFrame([(3,)], "address long"), got, got.where("false")).first()
    assert (s.evaluable_count, s.direct_correct, s.direct_ambiguous, s.direct_unknown, s.direct_precision, s.combined_coverage) == (2, 1, 1, 1, 1.0, 0.5)
    assert [(r.origin, r.known, r.unknown) for r in scoring.propagation_bound(cat, cat.where("false"), got).collect()] == [("f", 1, 1)]


def test_validators(spark):
    df = spark.createDataFrame([(1, ("x", "y"))], "id int, body struct<owner:string,name:string>")
    assert validate.forbidden_columns(df.schema) == ["body.owner"]
    with pytest.raises(validate.Invalid):
        validate.assert_label_free(df, "stage")
    with pytest.raises(validate.Invalid):
        validate.assert_none(df, "rows")
    with pytest.raises(validate.Invalid):
        validate.assert_agreement("runs", {"a": 1}, {"a": 2}, ("a",))
    assert validate.differences(df.select("id"), df.select("id")).count() == 0 and validate.duplicates(df.union(df), "id").count() == 1
    cat = spark.createDataFrame([("o", "m"), ("p", "m"), ("o", "n")], "origin string, member string")
    alias = spark.createDataFrame([("n", ["p", "q"]), ("k", ["a", "b"])], "member string, origins array<string>")
    assert {r.member: r.fault for r in validate.catalog_faults(cat, alias).collect()} == {"m": "repeated", "n": "alias against origin", "k": "alias of no member"}


def test_artifacts(spark, tmp_path):
    a, b = str(tmp_path / "a.json"), str(tmp_path / "d" / "b.json")
    sha = artifacts.write_json(a, artifacts.envelope("discovery", "s", {}, {"x": [1]}))
    artifacts.write_json(b, artifacts.envelope("body", "s", {"discovery": sha}, {"n": 2}))
    stages, digests = artifacts.load_stages({"discovery": a, "body": b})
    assert stages["body"]["payload"] == {"n": 2} and digests["discovery"] == sha
    assert artifacts.digest_files(spark, str(tmp_path / "a.json")).first().sha256 == sha
    assert artifacts.json_stage(spark, b, "n: int").first().n == 2
    artifacts.write_json(a, artifacts.envelope("discovery", "s", {}, {"x": [2]}))
    with pytest.raises(ValueError, match="another discovery"):
        artifacts.load_stages({"discovery": a, "body": b})
    with pytest.raises(ValueError, match="declared"):
        artifacts.read_json(a, "0" * 64)
    before = open(a, "rb").read()
    os.mkdir(tmp_path / "blocked")
    with pytest.raises(OSError):
        artifacts.publish({a: b"new", str(tmp_path / "blocked"): b"x"})
    assert open(a, "rb").read() == before and not [p for p in os.listdir(tmp_path) if p.endswith((".new", ".old"))]
    df = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    assert artifacts.table_digest(df) == artifacts.table_digest(df.orderBy(F.desc("k"))) != artifacts.table_digest(df.limit(1))
    assert artifacts.write_table(df, str(tmp_path / "t.parquet")) == artifacts.table_digest(df)
    assert artifacts.split_case_build("zox.O2") == ("zox", "O2") and artifacts.split_case_build("zox") == ("zox", None)
    assert artifacts.artifact_path("/r", "family", "c", "O2") == "/r/kind=family/case=c/build=O2/data.parquet"


def elf():
    code = b"\x90" * 16
    head = b"\x7fELF\x02\x01\x01" + b"\0" * 9 + struct.pack("<HHIQQQIHHHHHH", 2, 62, 1, 0x1004, 64, 0, 0, 64, 56, 1, 64, 0, 0)
    return head + struct.pack("<IIQQQQQQ", 1, 5, 120, 0x1000, 0, 16, 32, 0) + code


def test_images(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(elf())
    found = images.read_images(spark, str(tmp_path / "x.bin")).cache()
    row = found.first()
    assert row.format == "elf" and row.entry == 0x1004 and [tuple(s) for s in row.segments] == [(0x1000, 32, 120, 16, True)]
    extents = spark.createDataFrame([(0x1000, 4), (0x100E, 4), (0x2000, 1)], "address long, size long")
    contents = spark.read.format("binaryFile").load(str(tmp_path / "x.bin"))
    code = {r.address: r.code for r in images.read_bytes(extents, images.segments(found), contents).collect()}
    assert bytes(code[0x1000]) == b"\x90" * 4 and code[0x100E] is None and code[0x2000] is None
    assert images.boundary_functions(found).count() == images.import_functions(found).count() == 0
    with pytest.raises(images.NotAnImage):
        images.parse(b"\x7fELF\x01")
    with pytest.raises(images.NotAnImage):
        images.parse(b"MZ" + b"\0" * 80)


def test_streams(spark, tmp_path):
    rows = [("2024-01-01 00:01:00", "click", 1.0), ("2024-01-01 00:05:00", "click", 2.0), ("2024-01-01 00:15:00", "view", 3.0)]
    table = spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    q = windows.tumbling(stream, "10 minutes", "1 hour").writeStream.outputMode("update").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    got = {(str(r.window_start), r.event_type): r.n for r in spark.table("w").collect()}
    assert got == {("2024-01-01 00:00:00", "click"): 2, ("2024-01-01 00:10:00", "view"): 1}
    edges = windows.edge_counts(table.select("ts", F.lit(1).alias("source"), F.lit(2).alias("target")), "1 hour", "1 hour")
    assert edges.first()["count"] == 3


def test_classes_of_immediates_at_the_bound(spark):
    """body_evidence.py of the reference classes by the size of a number, whatever its sign."""
    numbers = ("-1048575", "-1048576", "1048575", "0x100000")
    got = one(spark, c=F.array(*(S.normalize_operand(F.lit(t), F.lit("immediate"), F.lit(None).cast("int"), F.lit("MOV")) for t in numbers)))
    assert got["c"] == ["imm_small", "imm_address_like", "imm_small", "imm_address_like"]


def test_overlapping_groups_are_counted_without_their_pairs(spark, monkeypatch):
    rng = random.Random(5)
    some = [(g, i) for i in range(60) for g in rng.sample(range(6), rng.choice((1, 1, 2, 3)))] + [(0, 3), (0, 3), (None, 5), (2, None)]
    more = [(i // 9, i) for i in range(60)] + [(99, 7), (99, 50)]
    p, t = (spark.createDataFrame(x, "group long, id long") for x in (some, more))
    monkeypatch.setattr(scoring, "TILE", 3)
    columns = ("true_positive", "false_positive", "false_negative", "true_negative", "precision", "recall", "f1")
    assert scoring.overlapping_confusion(p, t, 60).select(*columns).first() == scoring.pair_sets(scoring.overlapping_pairs(p), scoring.overlapping_pairs(t), 60).select(*columns).first()
    # two groups of the same 200,000 ids: 19,999,900,000 pairs
    large = spark.range(200_000).select(F.explode(F.array(F.lit(0), F.lit(1))).alias("group"), "id")
    got = scoring.overlapping_confusion(large, large.where("group = 0"), 200_000).first()
    assert (got.true_positive, got.false_positive, got.false_negative) == (200_000 * 199_999 // 2, 0, 0)


@pytest.mark.parametrize("tile", [(2, 3), (16384, 512)])
def test_cross_pairs_of_cores_that_overlap(spark, monkeypatch, tile):
    rng = random.Random(6)
    singles, ids = [f"k{i}" for i in range(12)], [f"m{i}" for i in range(30)] + ["k3", "k4", "k5"]
    cores = sorted({(f"F{rng.randrange(4)}", i) for i in ids for _ in range(rng.choice((1, 1, 2)))})
    pairs = [tuple(rng.sample((rng.choice(singles), rng.choice(ids)), 2)) for _ in range(25)]
    reached = {(x, f) for p in pairs for x, y in (p, p[::-1]) if x in singles for f, i in cores if i == y}
    want = sorted({(min(x, i), max(x, i)) for x, f in reached for g, i in cores if f == g})
    monkeypatch.setattr(labels, "MEMBERS", tile[0])
    monkeypatch.setattr(labels, "CORES", tile[1])
    got = labels.cross_pairs(spark.createDataFrame(pairs, "first string, second string"), spark.createDataFrame([(x,) for x in singles], "id string"), spark.createDataFrame(cores, "family_id string, id string"))
    assert sorted((r.first, r.second) for r in got.collect()) == want
    if tile[0] > 2:  # pairs of plain members are made behind the last shuffle
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Union") < plan.index("Join") and "Aggregate" not in plan[: plan.index("Join")]


def test_possible_pairs_of_both_kinds_of_cores(spark):
    fam = spark.createDataFrame([("A:1", "a", "accepted"), ("A:2", "b", "accepted"), ("B:1", "c", "accepted"), ("x", "x", "unresolved"), ("y", "y", "abstain")], "family_id string, id string, status string")
    strict = relaxed.strict_cores(fam)
    wide = strict.select(F.substring_index("family_id", ":", 1).alias("family_id"), "id")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    pairs = spark.createDataFrame([("a", "x"), ("y", "c")], "first string, second string").mapInArrow(count, "first string, second string")
    got = relaxed.possible_pairs(pairs, fam, {relaxed.STRICT: strict, relaxed.RESCUED: wide})
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [("rescue-core", "a", "x"), ("rescue-core", "b", "x"), ("strict-core", "a", "x")]
    assert seen.value == 2 and "Aggregate" not in plan[: plan.index("Join")]


def test_instructions_are_dealt_once_and_kept_tables_leave_no_shuffle_files(spark, sf):
    found = profiles.token_features(bindings.instructions(spark, sf))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1

    def shuffles():
        blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {b for i in range(blocks.size()) if (b := blocks.apply(i).toString()).startswith("shuffle_")}

    before = shuffles()
    tables.keep(found, "features")
    end = time.time() + 20
    while (left := shuffles() - before) and time.time() < end:
        time.sleep(0.2)
    assert not left


def test_cells_are_scored_some_rows_at_a_time(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(7)
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("key", pa.string()), ("n", pa.int64())]))
    bodies_ = [sorted([{"kind": 0, "key": k, "n": rng.choice((1, 1, 2, 5))} for k in rng.sample("abcde", rng.randint(0, 4))] + [{"kind": 1, "key": k, "n": 1} for k in rng.sample("abcdefghij", 4)], key=lambda f: (f["kind"], f["key"])) for _ in range(17)]
    ids = [f"p{i}" for i in rng.sample(range(100), 17)]
    table = pa.table({"sig": ids, "rep": ids, "ratios": [[float(rng.randint(0, 3))] for _ in ids], "sequences": pa.array([[]] * 17, pa.list_(pa.list_(pa.string()))), "equals": pa.array([[]] * 17, pa.list_(pa.string())), "features": pa.array(bodies_, kind)})
    view = retrieval.View("x", ratios=1, multisets=(0, 1))

    def jaccard(x, y, q):
        a, b = (Counter({f["key"]: f["n"] for f in bodies_[z] if f["kind"] == q}) for z in (x, y))
        return (a & b).total() / (a | b).total() if a | b else 1.0

    def score(x, y):
        p, q = table["ratios"][x].as_py()[0], table["ratios"][y].as_py()[0]
        return round(((1.0 if p == q == 0 else min(p, q) / max(p, q)) + jaccard(x, y, 0) + jaccard(x, y, 1)) / 3, 9)

    monkeypatch.setattr(retrieval, "ROWS", 3)
    for cut in (17, 10):  # a block with itself, two blocks
        some, more = retrieval._halves(table, np.arange(17) < cut)
        got = {}
        for sources, targets, i, j, found in retrieval._cell(view, some, more or some, not more, 2, 9):
            own, far = ([x for side in sides for x in side.sig] for sides in (sources, targets))
            for a, b, s in zip(i.tolist(), j.tolist(), found.tolist(), strict=True):
                got.setdefault(own[a], []).append((-s, far[b]))
        ends = [(range(17), range(17))] if cut == 17 else [(range(10), range(10, 17)), (range(10, 17), range(10))]
        assert got == {ids[x]: sorted((-score(x, y), ids[y]) for y in right if score(x, y) > 0)[:3] for left, right in ends for x in left}


def test_bodies_are_profiled_in_one_pass(spark, monkeypatch):
    from kinweave.functions import packs
    from kinweave.operators import onepass

    table, *_ = random_bodies(spark, 12)
    odd = [ins("e", 0, "conditional_branch", None), ins("e", 1, "jump_somewhere", 0), ins("e", 2, "local_jump", 99), ins("e", 3, "local_jump", -5), ins("e", 4, "indirect_jump"), ins("e", 9, None, operands=["[rax]", " ", "0x1f"], constants=[0, 1, 300]), ins("e", 10, "return"), ins("e", 12, "conditional_branch", 99), ins("g", 0), ins("h", 3, "external_jump", mnemonic=None), ins("h", 4, "call", operands=["call_target"])]
    table = table.unionByName(spark.createDataFrame(odd, INS)).cache()
    sizes = table.groupBy("id").agg(F.count("*").alias("size"))
    found = bodies.blocks(table, sizes).cache()
    edges = bodies.cfg_edges(found).cache()
    plain = {"token": profiles.token_features(table), "cfg": profiles.cfg_features(found, edges)}
    shape = {r.id: (r.block_count, r.edge_count) for r in found.groupBy("id").agg(F.count("*").alias("block_count")).join(edges.where("target NOT IN ('EXIT', 'OPAQUE')").groupBy("id").agg(F.count("*").alias("edge_count")), "id", "left").na.fill(0).collect()}
    lying = table.repartition(3, "id").sortWithinPartitions("id", "offset")
    for rows in (1 << 17, 5):  # all at once, a body or two at a time
        monkeypatch.setattr(onepass, "ROWS", rows)
        got = onepass.body_profiles(lying).collect()
        assert {r.id: (r.block_count, r.edge_count) for r in got} == shape and {r.id: r["size"] for r in got} == {r.id: r["size"] for r in sizes.collect()}
        for view in ("token", "cfg"):
            want, have = {}, {}
            for r in plain[view].collect():
                want.setdefault((r.kind, r.key), {})[r.id] = r.n
            for i, q, k, c in zip(*packs.unpack([r[view] for r in got]), strict=True):
                have.setdefault((int(q), int(k)), {})[got[i].id] = int(c)
            as_sets = lambda x: sorted((k[0], sorted(v.items())) for k, v in x.items())
            assert as_sets(have) == as_sets(want)
    for wrong in (table.repartition(1).sortWithinPartitions("id", F.desc("offset")), table.repartition(3).sortWithinPartitions("id", "offset")):
        with pytest.raises(Exception, match="must lie by id and offset"):
            onepass.body_profiles(wrong).collect()


def test_rough_scores_lose_no_pair(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from kinweave.functions import packs

    rng = np.random.default_rng(5)
    n, k = 60, 4
    row, kind, key, count = [], [], [], []
    for i in range(n):  # few keys with many counts, some with few, and many that few rows share; some rows have none of a kind
        for q, (most, keys) in enumerate(((300, 3), (9, 12), (2, 400))):
            mine = rng.choice(keys, min(keys, rng.integers(0, 12) if q else 2), replace=False)
            row += [i] * len(mine)
            kind += [q] * len(mine)
            key += mine.tolist()
            count += rng.integers(1, most, len(mine)).tolist() if most > 2 else [1] * len(mine)
    values, _ = packs.pack(n, *(np.array(x) for x in (row, kind, key, count)))
    ids = [f"p{i}" for i in rng.permutation(n)]
    table = pa.table({"rep": ids, "ratios": [[float(x), float(y)] for x, y in rng.integers(0, 5, (n, 2))], "sequences": pa.array([[]] * n, pa.list_(pa.list_(pa.string()))), "equals": pa.array([[]] * n, pa.list_(pa.string())), "packed": pa.array(values, pa.binary())})
    view = retrieval.View("x", ratios=2, multisets=(0, 1, 2))
    monkeypatch.setattr(retrieval, "SPARSE", 20)
    whole = retrieval._halves(table, np.ones(n, bool))[0]
    all_ = np.round(retrieval.score_block(view, whole[0], whole[0]), 9)
    monkeypatch.setattr(retrieval, "ROWS", 7)
    for cut in (n, 33):
        last = np.sort(all_[:, :cut], axis=1)[:, -k - 1] if cut < n else np.full(n, -np.inf)
        some, more = retrieval._halves(table.append_column("last", pa.array(last)), np.arange(n) < cut)
        for sources, targets, i, j, found in retrieval._cell(view, some, more or some, not more, k, 9):
            own, far = ([ids.index(x) for side in sides for x in side.rep] for sides in (sources, targets))
            got = {}
            for a, b, s in zip(i.tolist(), j.tolist(), found.tolist(), strict=True):
                assert s == all_[own[a], far[b]]
                got.setdefault(own[a], []).append(far[b])
            for a in own:
                best = sorted((-all_[a, b], ids[b], b) for b in far if all_[a, b] > 0 and all_[a, b] >= last[a])[: k + 1]
                assert [b for _, _, b in best] == [b for b in got.get(a, []) if all_[a, b] >= last[a]][: len(best)]


def test_multiview_candidates_keep_no_row_a_block(spark, sf, monkeypatch):
    from kinweave.plans import catalog
    from kinweave.sources import tables

    kept, keep = {}, tables.keep

    def counting(df, what, *args):
        out = keep(df, what, *args)
        kept[what] = max(kept.get(what, 0), out.count())
        return out

    monkeypatch.setattr(tables, "keep", counting)
    catalog.QUERIES["multiview_candidates"](spark, sf).collect()
    n = tables.read(spark, sf, "lineitem").select("l_suppkey").distinct().count()
    assert kept and max(kept.values()) <= n * (catalog.TOP + 1) * 2, kept
