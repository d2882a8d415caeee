"""More queries over the driver's tables: operators of discovery, retrieval, grouping, rescue, checks and scores, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions import scalars as S
from kinweave.operators import bodies, discovery, families, graph, grouping, labels, profiles, relaxed, retrieval, scoring, validate
from kinweave.plans import catalog
from kinweave.plans.catalog import query
from kinweave.sources import bindings, payloads, tables
from kinweave.streaming import windows

# discovery

SETTLED = catalog.SITES.rstrip() + """,
settled AS (SELECT source, callsite, CASE WHEN open AND n = 1 THEN targets[1] ELSE target END AS target, CASE WHEN open AND n = 1 THEN 'resolved' ELSE status END AS status, open, n FROM sites),
used AS (SELECT * FROM settled WHERE status IN ('resolved', 'unmapped') AND target IS NOT NULL)
"""


def _functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.read(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").cast("long").alias("address")).agg(F.count("*").alias("size")).select("address", "size", F.concat(F.lit("user"), "address").alias("name"), F.lit("events").alias("boundary_source"), F.lit("fcn").alias("kind"))


@query("WITH " + SETTLED + "SELECT source AS src, target AS dst, count(*) AS count FROM used GROUP BY ALL")
def resolved_call_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the call graph of resolved transfers."""
    return discovery.call_graph(_functions(spark, sf_dir), catalog._resolved(spark, sf_dir))[1]


@query("WITH " + SETTLED + """
SELECT target AS address, 'FUN_' || printf('%08x', target + 1048576) AS name, 'opaque-target' AS boundary_source, 0::BIGINT AS size FROM used WHERE target NOT IN (SELECT user_id FROM events) GROUP BY target""")
def opaque_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = discovery.call_graph(_functions(spark, sf_dir), catalog._resolved(spark, sf_dir))[0]
    return nodes.where("kind = 'opaque'").select("address", "name", "boundary_source", "size")


@query("WITH " + SETTLED + """
SELECT address, CASE WHEN opaque OR address = 7 THEN 'context-only' WHEN address % 4 = 0 THEN 'abstain' ELSE 'member' END AS role,
  CASE WHEN opaque THEN 'address-only' WHEN address % 4 = 0 THEN 'incomplete' ELSE 'complete' END AS analysis_status,
  CASE WHEN address = 7 THEN 'root' WHEN opaque THEN 'opaque:' || printf('%x', address) END AS colour
FROM (SELECT DISTINCT user_id::BIGINT AS address, false AS opaque FROM events UNION SELECT target, true FROM used WHERE target NOT IN (SELECT user_id FROM events))""")
def classified_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles and colours; every fourth user's body is incomplete, user 7 is the root."""
    nodes = discovery.call_graph(_functions(spark, sf_dir), catalog._resolved(spark, sf_dir))[0]
    quality = nodes.where("kind <> 'opaque'").select("address", (F.col("address") % 4 != 0).alias("complete_decode"))
    return discovery.classify(nodes, quality, 7).select("address", "role", "analysis_status", "colour")


@query("SELECT 'FUN_' || printf('%08x', user_id + 1048576) AS id, user_id::BIGINT AS address, 'incomplete' AS analysis_status, 'incomplete_body' AS reason FROM events WHERE user_id % 4 = 0 AND user_id <> 7 GROUP BY user_id")
def abstaining_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _functions(spark, sf_dir)
    return discovery.abstentions(discovery.classify(f, f.select("address", (F.col("address") % 4 != 0).alias("complete_decode")), 7))


@query("WITH " + SETTLED + """
, r AS (SELECT CASE WHEN NOT open THEN NULL WHEN n = 1 THEN 'a' WHEN n > 1 THEN 'b' WHEN EXISTS (SELECT 1 FROM tr WHERE tr.source = settled.source AND tr.callsite = settled.callsite AND tr.kind = 'tail-call') THEN 'c' ELSE 'd' END AS x FROM settled)
SELECT count(*) FILTER (x = 'a') AS resolved_singleton, count(*) FILTER (x = 'b') AS multiple_targets, count(*) FILTER (x = 'c') AS unresolvable_target, count(*) FILTER (x = 'd') AS not_seen, count(*) FILTER (x IN ('b', 'c', 'd')) AS unresolved_after, round(count(*) FILTER (x = 'a') / count(x), 4) AS resolution_rate FROM r""")
def resolution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.resolution_summary(catalog._resolved(spark, sf_dir))


VISIBLE = bindings.RELATION.rstrip() + """,
st AS (SELECT id, role = 'context-only' OR id IN (SELECT src FROM edges WHERE src <> dst) OR id IN (SELECT dst FROM edges WHERE src <> dst) AS seen FROM nodes)
"""


@query("WITH " + VISIBLE + "SELECT src, dst, n AS count FROM edges WHERE src IN (SELECT id FROM st WHERE seen) AND dst IN (SELECT id FROM st WHERE seen)")
def visible_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = bindings.relation(spark, sf_dir)
    return discovery.visible_edges(edges, discovery.relation_status(nodes, edges))


@query("SELECT l_partkey AS address FROM lineitem WHERE (l_partkey // 10) % 3 <> 1 AND l_partkey < 1000")
def executable_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts inside segments of ten addresses, of which every third is missing."""
    segments = spark.range(100).where("id % 3 <> 1").select((F.col("id") * 10).alias("start"), F.lit(10).cast("long").alias("size"))
    return discovery.executable(tables.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("address")), segments, "address")


# bodies and profiles


@query("WITH " + catalog.ROLES + """,
h0 AS (SELECT id, label, sha256(n_instructions || ':' || i || ':' || o || ':' || CASE last_flow WHEN 'conditional_branch' THEN 'conditional' WHEN 'local_jump' THEN 'jump' WHEN 'external_jump' THEN 'jump' ELSE last_flow END || ':' || (i = 0)::VARCHAR || ':' || (o = 0)::VARCHAR) AS t FROM degrees),
""" + ",\n".join(f"""
s{k} AS (SELECT id, label, string_agg(s, '|' ORDER BY s) AS s FROM (
  SELECT e.id, e.source AS label, 'o>' || kind || '>' || t AS s FROM inner_edges e JOIN h{k - 1} ON h{k - 1}.id = e.id AND h{k - 1}.label = e.target
  UNION ALL SELECT e.id, e.target, 'i>' || kind || '>' || t FROM inner_edges e JOIN h{k - 1} ON h{k - 1}.id = e.id AND h{k - 1}.label = e.source) GROUP BY ALL),
h{k} AS (SELECT h.id, h.label, sha256(t || '#' || coalesce(s, '')) AS t FROM h{k - 1} h LEFT JOIN s{k} USING (id, label))""" for k in (1, 2)) + """
SELECT id, CAST(0 AS INTEGER) AS kind, n_instructions || ':' || i || ':' || o || ':' || CASE last_flow WHEN 'conditional_branch' THEN 'conditional' WHEN 'local_jump' THEN 'jump' WHEN 'external_jump' THEN 'jump' ELSE last_flow END || ':' || (i = 0)::VARCHAR || ':' || (o = 0)::VARCHAR AS key, count(*) AS n FROM degrees GROUP BY ALL
UNION ALL SELECT id, 1, kind, count(*) FROM edg GROUP BY ALL
UNION ALL SELECT id, 2, i || ':' || o, count(*) FROM degrees GROUP BY ALL
UNION ALL SELECT id, 3, t, count(*) FROM h2 GROUP BY ALL""")
def cfg_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles, edge kinds, degrees and refined labels of blocks."""
    found = tables.keep(catalog._blocks(spark, sf_dir)[1], "blocks")
    return profiles.cfg_features(found, bodies.cfg_edges(found))


@query("""
WITH i AS (SELECT l_orderkey AS id, l_linenumber * 2 - 2 AS pos, CASE WHEN l_quantity > 45 THEN 1 ELSE 2 END AS size FROM lineitem),
s AS (SELECT id, pos, size, coalesce(lag(pos + size) OVER (PARTITION BY id ORDER BY pos), 0) AS due FROM i),
e AS (SELECT id, bool_or(pos <> due) AS gap, max(pos + size) AS ends FROM s GROUP BY id),
f AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE 2 * coalesce(n, 1) END AS size, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 1 ELSE 99 END AS got FROM orders LEFT JOIN (SELECT l_orderkey, max(l_linenumber) AS n FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey),
r AS (SELECT f.id, CASE WHEN got IS NULL OR f.size <= 0 THEN 'extent_not_file_backed' WHEN got < f.size THEN 'truncated_extent' WHEN ends IS NULL THEN 'zero_instruction_decode' WHEN gap OR ends <> f.size THEN 'decode_gap' END AS failure_reason FROM f LEFT JOIN e ON e.id = f.id)
SELECT id, failure_reason IS NULL AS complete_decode, failure_reason FROM r""")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose line items follow each other and fill them."""
    line, o = tables.read(spark, sf_dir, "lineitem"), tables.read(spark, sf_dir, "orders")
    ins = line.select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") * 2 - 2).alias("offset"), F.when(F.col("l_quantity") > 45, 1).otherwise(2).alias("size"))
    n = line.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linenumber").alias("n"))
    k = F.col("o_orderkey")
    f = o.select("o_orderkey").join(n, "o_orderkey", "left").select(k.alias("id"), F.when(k % 11 == 0, 0).otherwise(2 * F.coalesce("n", F.lit(1))).alias("size"), F.when(k % 7 == 0, None).when(k % 5 == 0, 1).otherwise(99).alias("bytes_read"))
    return bodies.completeness(f, ins)


# retrieval

GROUPED = """
grp AS (SELECT 0 AS round, 's' || s_suppkey AS id, 'n' || s_nationkey AS c FROM supplier UNION ALL SELECT 1, 's' || s_suppkey, 'n' || s_nationkey || CASE WHEN s_acctbal >= 0 THEN '+' ELSE '-' END FROM supplier),
near AS (SELECT a.round, source, target, score FROM (""" + catalog.TOKEN_SCORE + """) JOIN grp a ON a.id = source JOIN grp b ON b.id = target AND b.round = a.round AND b.c = a.c WHERE score > 0),
own AS (SELECT *, row_number() OVER (PARTITION BY round, source ORDER BY score DESC, target) AS rank FROM near)
"""


def _grouped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(instructions, token profiles, groups of suppliers in two rounds)."""
    ins = bindings.instructions(spark, sf_dir)
    rows = tables.keep(profiles.token_profiles(bindings.sizes(ins), profiles.token_features(ins)), "profiles")
    s = tables.read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("n"), "s_nationkey").alias("c"), "s_acctbal")
    groups = s.select(F.lit(0).alias("round"), "id", F.col("c").alias("cluster")).unionByName(s.select(F.lit(1).alias("round"), "id", F.concat("c", F.when(F.col("s_acctbal") >= 0, "+").otherwise("-")).alias("cluster")))
    return ins, rows, groups


@query("WITH " + catalog.TOKENS + "," + catalog.PAIRED.rstrip() + "," + GROUPED + "SELECT round, source, target, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM own WHERE rank <= 3")
def grouped_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most similar suppliers of the same group in each round."""
    _, rows, groups = _grouped(spark, sf_dir)
    return retrieval.within_groups(rows, groups, retrieval.TOKEN, 3, digits=9).select("round", "source", "target", F.round("score", 6).alias("score"), "rank")


@query("WITH " + catalog.TOKENS + "," + catalog.PAIRED.rstrip() + "," + GROUPED.rstrip() + """,
whole AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, target) AS rank FROM (""" + catalog.TOKEN_SCORE + """) WHERE score > 0),
u AS (SELECT least(source, target) AS first, greatest(source, target) AS second, score, rank AS br, NULL AS rr, NULL AS round, 'body_top_k' AS reason FROM whole WHERE rank <= 3
  UNION ALL SELECT least(source, target), greatest(source, target), score, NULL, rank, round, 'same_colour_top_k' FROM own WHERE rank <= 2)
SELECT first, second, round(max(score), 6) AS score, CAST(min(br) AS INTEGER) AS body_rank, CAST(min(rr) AS INTEGER) AS relation_rank, CAST(max(round) AS INTEGER) AS last_shared_round, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM u GROUP BY ALL""")
def legacy_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ins, rows, groups = _grouped(spark, sf_dir)
    body, inside = retrieval.top_k(rows, retrieval.TOKEN, 3, digits=9), retrieval.within_groups(rows, groups, retrieval.TOKEN, 2, digits=9)
    hashes = tables.keep(profiles.token_hashes(ins).withColumnRenamed("exact_token_hash", "exact_hash"), "hashes")
    found = retrieval.legacy_candidates(body, inside, hashes)
    return found.withColumn("reasons", F.array_join(F.filter("reasons", lambda r: r != "same_exact_hash"), ",")).withColumn("score", F.round("score", 6))


NOTED = catalog.COLOURS.rstrip() + "," + catalog._round(1) + "," + catalog._round(2) + """,
hubs AS (SELECT c_nationkey, min('c' || c_custkey) AS hub FROM customer GROUP BY ALL),
cand AS (SELECT hub AS first, 'c' || c_custkey AS second FROM customer JOIN hubs USING (c_nationkey) WHERE 'c' || c_custkey <> hub),
named AS (SELECT id, coalesce(anchor, role) AS c FROM nodes),
sig AS (SELECT src AS id, string_agg(coalesce(c, 'external') || '*' || n, ',' ORDER BY coalesce(c, 'external') || '*' || n) AS s FROM edges LEFT JOIN named ON named.id = dst GROUP BY src)
"""


@query("WITH " + NOTED + """
SELECT first, second, a2.c = b2.c AS same_final_colour, a0.c = b0.c OR a1.c = b1.c AS same_prior_colour, CASE WHEN a2.c = b2.c THEN 2 WHEN a1.c = b1.c THEN 1 WHEN a0.c = b0.c THEN 0 END AS last_shared_round, x.s = y.s AS same_out_signature
FROM cand JOIN r0 a0 ON a0.id = first JOIN r0 b0 ON b0.id = second JOIN r1 a1 ON a1.id = first JOIN r1 b1 ON b1.id = second JOIN r2 a2 ON a2.id = first JOIN r2 b2 ON b2.id = second LEFT JOIN sig x ON x.id = first LEFT JOIN sig y ON y.id = second""")
def annotated_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a nation against its first: colours they share in three rounds, and equal signatures."""
    nodes, edges = bindings.relation(spark, sf_dir)
    groups = graph.clusters(graph.refine(nodes, edges, rounds=2))
    sigs = graph.signatures(edges, nodes.select("id", F.coalesce("anchor", "role").alias("colour")))
    c = tables.read(spark, sf_dir, "customer").select("c_nationkey", F.concat(F.lit("c"), "c_custkey").alias("second"))
    pairs = c.join(c.groupBy("c_nationkey").agg(F.min("second").alias("first")), "c_nationkey").where("first <> second").select("first", "second")
    return retrieval.annotate(pairs, groups, sigs, 2).select("first", "second", "same_final_colour", "same_prior_colour", "last_shared_round", "same_out_signature")


def _rounds_sql(most: int) -> str:
    """Rounds of refinement up to the first that splits nothing; more than ``most`` are not told."""
    n = ", ".join(f"(SELECT count(DISTINCT c) FROM r{k}) AS n{k}" for k in range(most + 1))
    parts = [catalog._clusters_sql(0)]
    for k in range(1, most + 1):
        grew = " AND ".join([f"n{j} > n{j - 1}" for j in range(1, k)] or ["true"])
        parts.append(f"SELECT * FROM ({catalog._clusters_sql(k)}) WHERE (SELECT {grew} FROM counts)")
    return "WITH " + catalog.COLOURS.rstrip() + "," + ",".join(catalog._round(k) for k in range(1, most + 1)) + f", counts AS (SELECT {n}) " + " UNION ALL ".join(parts)


@query(_rounds_sql(5))
def colour_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refinement to its fixpoint."""
    return graph.clusters(graph.refine(*bindings.relation(spark, sf_dir)))


# grouping

STATUS = """
mem AS (SELECT 's' || s_suppkey AS id, min('s' || s_suppkey) OVER (PARTITION BY s_nationkey, s_acctbal >= 5000) AS least, s_suppkey AS k FROM supplier),
body AS (SELECT 's' || s_suppkey AS id, s_suppkey % 5 <> 0 AS whole, CASE WHEN s_suppkey % 9 = 0 THEN 1 ELSE 0 END AS opaque FROM supplier WHERE s_suppkey % 13 <> 0),
near AS (SELECT DISTINCT unnest(['s' || a.s_suppkey, 's' || b.s_suppkey]) AS id FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 2 WHERE a.s_suppkey % 4 = 1),
st AS (SELECT mem.id, least, count(*) OVER (PARTITION BY least) AS n, CASE WHEN body.id IS NULL THEN 'missing_body' WHEN NOT whole THEN 'incomplete_decode' WHEN opaque > 0 THEN 'opaque_indirect_jump' END AS reason, near.id IS NOT NULL AS has FROM mem LEFT JOIN body ON body.id = mem.id LEFT JOIN near ON near.id = mem.id),
fs AS (SELECT id, least, reason, CASE WHEN n > 1 THEN 'accepted' WHEN reason IS NOT NULL THEN 'abstain' WHEN has THEN 'provisional' ELSE 'unresolved' END AS status FROM st),
nm AS (SELECT least, 'family_' || sha256('[' || string_agg('"' || id || '"', ',' ORDER BY id) || ']') AS family_id FROM mem GROUP BY least)
"""


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables.read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    ids = s.select(F.concat(F.lit("s"), k).alias("id"), "s_nationkey", (F.col("s_acctbal") >= 5000).alias("rich"), k.alias("k"))
    members = ids.join(ids.groupBy("s_nationkey", "rich").agg(F.min("id").alias("least")), ["s_nationkey", "rich"]).select("id", "least")
    body = ids.where("k % 13 <> 0").select("id", (F.col("k") % 5 != 0).alias("complete_decode"), F.when(F.col("k") % 9 == 0, 1).otherwise(0).alias("opaque_indirect_jumps"))
    other = ids.select(F.col("id").alias("second"), (F.col("k") - 2).alias("k"))
    made = ids.where("k % 4 = 1").join(other, "k").select(F.col("id").alias("first"), "second", F.lit("match").alias("decision"))
    return grouping.family_status(members, made, body, S.PairPolicy())


@query("WITH " + STATUS + "SELECT id, family_id, status, reason AS abstain_reason FROM fs JOIN nm USING (least)")
def family_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a nation and a class of balance as families; some bodies are missing, incomplete or opaque."""
    return _statuses(spark, sf_dir)


@query("WITH " + STATUS + "SELECT status, count(*) AS members, count(DISTINCT least) AS families FROM fs GROUP BY status")
def family_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.summary(_statuses(spark, sf_dir))


@query("WITH " + STATUS + """
SELECT id, CASE WHEN k % 17 = 0 THEN 'in no family' WHEN k % 19 = 0 THEN 'unknown status' WHEN status = 'accepted' AND (SELECT count(*) FROM fs x JOIN mem y USING (id) WHERE x.least = fs.least AND y.k % 17 <> 0) < 2 THEN 'size against status'
  WHEN EXISTS (SELECT 1 FROM mem y WHERE y.least = fs.least AND y.k % 17 = 0) THEN 'family id against members' END AS fault
FROM fs JOIN mem USING (id, least) WHERE k % 17 = 0 OR k % 19 = 0 OR (EXISTS (SELECT 1 FROM mem y WHERE y.least = fs.least AND y.k % 17 = 0))""")
def family_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of which some members were lost and some statuses spoilt."""
    table = tables.keep(_statuses(spark, sf_dir), "statuses")
    k = F.substring("id", 2, 20).cast("long")
    spoilt = table.where(k % 17 != 0).withColumn("status", F.when(k % 19 == 0, "odd").otherwise(F.col("status")))
    return validate.family_faults(spoilt, table.select("id"))


@query("WITH RECURSIVE " + catalog.STARS + f""",
cost AS (SELECT min(grp.id) AS component, count(n) AS k, count(n) * (count(n) - 1) // 2 AS comparisons, coalesce((sum(n) * sum(n) - sum(n * n)) // 2, 0)::BIGINT AS cells FROM grp LEFT JOIN len USING (id) GROUP BY g),
o AS (SELECT *, row_number() OVER (ORDER BY cells, comparisons, component) AS i FROM cost WHERE comparisons > 0),
walk AS (SELECT 0::BIGINT AS i, ''::VARCHAR AS component, 25::HUGEINT AS c, {catalog.CELLS}::HUGEINT AS x, false AS took
  UNION ALL SELECT o.i, o.component, CASE WHEN o.comparisons <= c AND o.cells <= x THEN c - o.comparisons ELSE c END, CASE WHEN o.comparisons <= c AND o.cells <= x THEN x - o.cells ELSE x END, o.comparisons <= c AND o.cells <= x FROM walk JOIN o ON o.i = walk.i + 1)
SELECT cost.component, cost.comparisons, cost.cells, cost.comparisons = 0 OR coalesce(took, false) AS selected FROM cost LEFT JOIN walk USING (component)""")
def greedy_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components admitted under two ceilings: one that doesn't fit is passed over."""
    ids, pairs = catalog._stars(spark, sf_dir)
    members = tables.keep(graph.components(ids, pairs), "components")
    costs = tables.keep(grouping.component_costs(members, catalog._lengths(spark, sf_dir)), "costs")
    return grouping.admit(costs, S.PairPolicy(max_comparisons=25, max_cells=catalog.CELLS)).select("component", "comparisons", "cells", "selected")


@query("WITH " + catalog.STARS + f""",
cost AS (SELECT g, min(grp.id) AS component, coalesce((sum(n) * sum(n) - sum(n * n)) // 2, 0)::BIGINT AS cells, count(n) * (count(n) - 1) // 2 AS comparisons FROM grp LEFT JOIN len USING (id) GROUP BY g),
chosen AS (SELECT g FROM (SELECT *, sum(cells) OVER (ORDER BY cells, comparisons, component) <= {catalog.CELLS} AS s FROM cost) WHERE s)
SELECT first, second FROM stars WHERE second IN (SELECT id FROM grp JOIN chosen USING (g))""")
def budgeted_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs whose components fit a ceiling of cells."""
    ids, pairs = catalog._stars(spark, sf_dir)
    members = tables.keep(graph.components(ids, pairs), "components")
    costs = tables.keep(grouping.component_costs(members, catalog._lengths(spark, sf_dir)), "costs")
    return grouping.budgeted(pairs, members, grouping.admit(costs, S.PairPolicy(max_comparisons=None, max_cells=catalog.CELLS)))


# rescue

REACH = """
WITH RECURSIVE fr AS (SELECT 's' || s_suppkey AS id, 'F' || s_nationkey AS fragment, s_suppkey AS k, s_nationkey AS nat FROM supplier),
met AS (SELECT a.fragment AS fa, b.fragment AS fb, a.id AS x, b.id AS y, a.k % 3 = 0 AS prior FROM fr a JOIN fr b ON b.k = a.k + 1 WHERE a.nat <> b.nat AND abs(b.nat - a.nat) <= 2 AND least(a.nat, b.nat) % 5 < 2),
both_ AS (SELECT fa, fb FROM met UNION SELECT fb, fa FROM met),
walk AS (SELECT DISTINCT fragment, fragment AS root FROM fr UNION SELECT both_.fb, walk.root FROM walk JOIN both_ ON both_.fa = walk.fragment),
comp AS (SELECT fragment, min(root) AS component FROM walk GROUP BY fragment),
big AS (SELECT fragment, component FROM comp WHERE component IN (SELECT component FROM comp GROUP BY component HAVING count(*) > 1)),
len AS (SELECT 's' || l_suppkey AS id, count(*) AS n FROM lineitem GROUP BY ALL)
"""


def _fragments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fragments, their components, bridges): suppliers of a nation, and pairs of neighbours by number from near nations."""
    s = tables.read(spark, sf_dir, "supplier")
    f = s.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("F"), "s_nationkey").alias("fragment"), F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nat"))
    b = f.select(F.col("id").alias("second"), (F.col("k") - 1).alias("k"), F.col("nat").alias("nb"))
    pairs = f.join(b, "k").where("nat <> nb AND abs(nb - nat) <= 2 AND least(nat, nb) % 5 < 2").select(F.col("id").alias("first"), "second", (F.col("k") % 3 == 0).alias("same_prior_colour"))
    fragments = families.fragments_of(f.select("id", F.col("fragment").alias("family_id"), F.lit("accepted").alias("status")))
    return (fragments, *families.rescue_components(fragments, pairs))


@query(REACH + "SELECT fragment, component FROM big")
def rescue_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fragments(spark, sf_dir)[1]


@query(REACH + "SELECT DISTINCT component, least(x, y) AS first, greatest(x, y) AS second FROM met JOIN big ON big.fragment = met.fa WHERE prior")
def rescue_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fragments(spark, sf_dir)[2]


COSTS = REACH.rstrip() + """,
mem AS (SELECT component, fr.id, n FROM big JOIN fr USING (fragment) JOIN len ON len.id = fr.id),
sums AS (SELECT component, count(*) AS n_members, sum(n) AS s, sum(n * n) AS q FROM mem GROUP BY component),
cost AS (SELECT component, n_members, n_members * (n_members - 1) // 2 + n_members - 1 AS comparisons, ((s * s - q) // 2 + (SELECT max(n * (sums.s - n)) FROM mem WHERE mem.component = sums.component))::BIGINT AS cells FROM sums)
"""


@query(COSTS + "SELECT * FROM cost")
def rescue_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a component, and the worst medoid against the others."""
    fragments, comp, _ = _fragments(spark, sf_dir)
    return families.reserve(fragments.join(comp, "fragment").select("component", "id"), catalog._lengths(spark, sf_dir))


@query(COSTS + """, o AS (SELECT *, row_number() OVER (ORDER BY cells, comparisons, component) AS i FROM cost WHERE n_members <= 60),
walk2 AS (SELECT 0::BIGINT AS i, ''::VARCHAR AS component, 900::HUGEINT AS c, 40000000::HUGEINT AS x, false AS took
  UNION ALL SELECT o.i, o.component, CASE WHEN o.comparisons <= c AND o.cells <= x THEN c - o.comparisons ELSE c END, CASE WHEN o.comparisons <= c AND o.cells <= x THEN x - o.cells ELSE x END, o.comparisons <= c AND o.cells <= x FROM walk2 JOIN o ON o.i = walk2.i + 1)
SELECT cost.component, CASE WHEN n_members > 60 OR NOT coalesce(took, false) THEN 'budget_blocked' ELSE 'accepted' END AS status, CASE WHEN n_members > 60 THEN 'too_many_members' WHEN NOT coalesce(took, false) THEN 'over_budget' END AS reason FROM cost LEFT JOIN walk2 USING (component)""")
def rescue_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    fragments, comp, _ = _fragments(spark, sf_dir)
    costs = tables.keep(families.reserve(fragments.join(comp, "fragment").select("component", "id"), catalog._lengths(spark, sf_dir)), "costs")
    verdicts = comp.select("component", F.lit("accepted").alias("status"), F.lit(None).cast("string").alias("reason")).distinct()
    return families.rescue(comp.select("component").distinct(), costs, verdicts, max_members=60, max_comparisons=900, max_cells=40_000_000)


@query("WITH " + bindings.FILLED + """,
per AS (SELECT family, off, bool_and(value IS NOT NULL) AS ok, count(DISTINCT coalesce(value, '')) AS n FROM filled GROUP BY ALL)
SELECT family, count(*) AS n_slots, count(*) FILTER (ok) AS observed_by_all, count(*) FILTER (ok AND n > 1) AS varying, 0::BIGINT AS call_target, 0::BIGINT AS tail_call_target, count(*) AS data_reference, 0::BIGINT AS immediate_constant FROM per GROUP BY family""")
def slot_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.axis_report(bindings.filled_slots(spark, sf_dir)).withColumn("observed_by_all", F.col("observed_by_all").cast("long"))


@query("WITH " + bindings.FILLED + """,
per AS (SELECT family, off, bool_and(value IS NOT NULL) AS ok, count(DISTINCT value) AS n, bool_or(value IS NULL) AS m, bool_or(value IS NOT NULL) AS r FROM filled GROUP BY ALL)
SELECT family, off AS "offset", CASE WHEN ok THEN 'invariant' ELSE 'not_resolved_for_every_member' END AS reason, CASE WHEN m AND r THEN 'missing,resolved' WHEN m THEN 'missing' ELSE 'resolved' END AS states FROM per WHERE NOT (ok AND n > 1)""")
def excluded_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.excluded_slots(bindings.filled_slots(spark, sf_dir)).select("family", "offset", "reason", F.array_join("states", ",").alias("states"))


ROLED = catalog.BLOCKS.rstrip() + """,
mem AS (SELECT s_nationkey AS family, 's' || s_suppkey AS id FROM supplier),
med AS (SELECT family, min(id) AS medoid FROM mem GROUP BY family),
hit AS (SELECT mem.family, mem.id, b.label FROM mem JOIN med USING (family) JOIN blk b ON b.id = mem.id JOIN blk m ON m.id = medoid AND m.label = b.label AND m.n_instructions = b.n_instructions WHERE mem.id <> medoid)
"""


def _roles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    found = tables.keep(catalog._blocks(spark, sf_dir)[1], "blocks")
    members = tables.read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("family"), F.concat(F.lit("s"), "s_suppkey").alias("id"))
    medoid = members.groupBy("family").agg(F.min("id").alias("medoid"))
    mine = found.select(F.col("id").alias("medoid"), "label", "n_instructions")
    matched = members.join(medoid, "family").where("id <> medoid").join(found.select("id", "label", "n_instructions"), "id").join(mine, ["medoid", "label", "n_instructions"]).select("family", "id", "label")
    return members, medoid, found, matched


@query("WITH " + ROLED + """SELECT med.family, b.label, CASE WHEN (SELECT count(DISTINCT hit.id) FROM hit WHERE hit.family = med.family AND hit.label = b.label) + 1 = (SELECT count(*) FROM mem WHERE mem.family = med.family) THEN 'common' ELSE 'optional' END AS role FROM med JOIN blk b ON b.id = medoid""")
def block_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.block_roles(*_roles(spark, sf_dir))


@query("WITH " + ROLED + "SELECT mem.family, mem.id, b.label FROM mem JOIN med USING (family) JOIN blk b ON b.id = mem.id WHERE mem.id <> medoid AND NOT EXISTS (SELECT 1 FROM hit WHERE hit.id = mem.id AND hit.label = b.label)")
def orphan_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.orphan_blocks(*_roles(spark, sf_dir)).select("family", "id", "label")


# labels, relaxed attachment, scores


@query("WITH " + catalog.ATTACH + """,
m AS (SELECT DISTINCT first, family_id FROM dec JOIN core ON core.id = second WHERE decision = 'match' AND source = 'candidate'),
cold AS (SELECT id FROM cand WHERE substr(id, 2)::BIGINT % 3 <> 0)
SELECT 'strict-core' AS partition, first, core.id AS second FROM m JOIN cold ON cold.id = first JOIN core USING (family_id)
UNION ALL SELECT 'rescue-core', x.first, core.id FROM (SELECT DISTINCT first, regexp_extract(family_id, '^[^:]*') AS f FROM m JOIN cold ON cold.id = first) x JOIN core ON regexp_extract(core.family_id, '^[^:]*') = f""")
def relaxed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that strict cores and wider ones could ask for; a third of the candidates abstain."""
    dec, cand, core = catalog._attachment(spark, sf_dir)
    fam = core.withColumn("status", F.lit("accepted")).unionByName(cand.select(F.col("id").alias("family_id"), "id", F.when(F.substring("id", 2, 20).cast("long") % 3 == 0, "abstain").otherwise("unresolved").alias("status")))
    wide = core.select(F.substring_index("family_id", ":", 1).alias("family_id"), "id")
    return relaxed.possible_pairs(dec.where("decision = 'match' AND source = 'candidate'"), fam, {relaxed.STRICT: relaxed.strict_cores(fam), relaxed.RESCUED: wide})


@query("WITH " + catalog.ATTACH + """,
per AS (SELECT first AS member, family_id FROM dec JOIN core ON core.id = second GROUP BY ALL HAVING count(*) FILTER (decision = 'reject') = 0 AND count(*) FILTER (decision = 'match' AND source = 'candidate') > 0),
one AS (SELECT member, min(family_id) AS f FROM per GROUP BY member HAVING count(*) = 1)
SELECT family_id AS "group", id FROM core UNION SELECT f || '+' || member, id FROM one JOIN core ON family_id = f UNION SELECT f || '+' || member, member FROM one""")
def scoring_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each core, and each core with one attached member at a time."""
    dec, cand, core = catalog._attachment(spark, sf_dir)
    return labels.scoring_groups(core, labels.attach(dec, cand, core))


@query("SELECT *, round(propagated_correct / (propagated_correct + propagated_incorrect), 6) AS propagated_precision, round(combined_correct / evaluable_count, 6) AS combined_coverage FROM (WITH " + catalog.CATALOG.rstrip() + """,
gj AS (SELECT s.member AS address, CASE WHEN cat.address IS NULL THEN 'unknown' WHEN s.member IN (SELECT address FROM amb) THEN 'ambiguous' WHEN s.canonical_origin = cat.origin AND s.owner = cat.owner THEN 'correct' ELSE 'incorrect' END AS v FROM given s LEFT JOIN cat ON cat.address = s.member),
cj AS (SELECT * FROM dj UNION ALL SELECT * FROM gj WHERE address NOT IN (SELECT address FROM dj))
SELECT (SELECT count(*) FROM cat WHERE address NOT IN (SELECT address FROM amb)) AS evaluable_count, """ + ", ".join(f"(SELECT count(*) FROM {t} WHERE v = '{v}') AS {n}_{v}" for n, t in (("propagated", "gj"), ("combined", "cj")) for v in ("correct", "incorrect", "ambiguous", "unknown")) + ")")
def propagated_catalog_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ("correct", "incorrect", "ambiguous", "unknown")
    out = scoring.catalog_scores(*catalog._catalog(spark, sf_dir))
    return out.select("evaluable_count", *(f"{n}_{v}" for n in ("propagated", "combined") for v in kinds), "propagated_precision", "combined_coverage")


NEUTRAL = catalog.CONFUSION.rstrip() + """,
ng AS (SELECT doc_id AS a, doc_id + 1 AS b FROM documents WHERE doc_id % 3 = 0 AND doc_id + 1 IN (SELECT doc_id FROM documents)),
nx AS (SELECT count(*) AS t, count(*) FILTER (p.g = q.g AND x.o = y.o) AS tp, count(*) FILTER (p.g = q.g) AS pp, count(*) FILTER (x.o = y.o) AS tt FROM ng JOIN pred p ON p.id = a JOIN pred q ON q.id = b JOIN tru x ON x.id = a JOIN tru y ON y.id = b)
"""


@query("WITH " + NEUTRAL + """
SELECT m AS scored_member_count, (c.tp - nx.tp)::BIGINT AS true_positive, (c.fp - (nx.pp - nx.tp))::BIGINT AS false_positive, (c.fn - (nx.tt - nx.tp))::BIGINT AS false_negative, (m * (m - 1) // 2 - t - (c.tp - nx.tp) - (c.fp - nx.pp + nx.tp) - (c.fn - nx.tt + nx.tp))::BIGINT AS true_negative, t AS neutral_pair_total, t AS duplicate_neutral FROM c, nx""")
def neutral_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair confusion without pairs that can't be judged: every third document and the next."""
    t = bindings.truth(spark, sf_dir)
    d = tables.read(spark, sf_dir, "documents").select("doc_id")
    neutral = d.where("doc_id % 3 = 0").join(d.select((F.col("doc_id") - 1).alias("doc_id")), "doc_id").select(F.col("doc_id").alias("first"), (F.col("doc_id") + 1).alias("second"), F.lit("duplicate").alias("label"))
    return scoring.pair_confusion(bindings.partition(spark, sf_dir), t, t.select("id"), neutral).select("scored_member_count", "true_positive", "false_positive", "false_negative", "true_negative", "neutral_pair_total", "duplicate_neutral")


SETS = """
g AS (SELECT l_suppkey % 40 AS "group", l_orderkey AS id FROM lineitem WHERE l_quantity > 48),
p AS (SELECT DISTINCT a.id AS first, b.id AS second FROM g a JOIN g b USING ("group") WHERE a.id < b.id),
t AS (SELECT DISTINCT a.o_orderkey AS first, b.o_orderkey AS second FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey)
"""


@query("WITH " + SETS + "SELECT x AS true_positive, a - x AS false_positive, b - x AS false_negative, round(x / a, 4) AS precision, round(x / b, 4) AS recall FROM (SELECT (SELECT count(*) FROM p JOIN t USING (first, second)) AS x, (SELECT count(*) FROM p) AS a, (SELECT count(*) FROM t) AS b)")
def overlapping_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of groups that overlap, as sets, against orders of one customer."""
    line, o = tables.read(spark, sf_dir, "lineitem"), tables.read(spark, sf_dir, "orders")
    predicted = line.where("l_quantity > 48").select((F.col("l_suppkey") % 40).alias("group"), F.col("l_orderkey").alias("id"))
    true = o.select(F.col("o_custkey").alias("group"), F.col("o_orderkey").alias("id"))
    return scoring.overlapping_confusion(predicted, true, 10**6).select("true_positive", "false_positive", "false_negative", "precision", "recall")


@query("WITH l AS (SELECT lang, sum(n * (n - 1) // 2)::BIGINT AS p FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) GROUP BY lang), w AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang) SELECT 'by-source' AS method, sum(n)::BIGINT AS scored_member_count, sum(p)::BIGINT AS true_positive, 0::BIGINT AS false_positive, (sum(n * (n - 1) // 2) - sum(p))::BIGINT AS false_negative, round(sum(p) / sum(n * (n - 1) // 2), 4) AS recall FROM l JOIN w USING (lang)")
def micro_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts summed over languages as subjects: sources as groups against one origin a language."""
    d = tables.read(spark, sf_dir, "documents")
    out = None
    for lang in ("en", "de", "fr", "es"):
        own = d.where(F.col("lang") == lang)
        row = scoring.pair_confusion(own.select(F.col("source").alias("group"), F.col("doc_id").alias("id")), own.select(F.col("lang").alias("origin"), F.col("doc_id").alias("id")), own.select(F.col("doc_id").alias("id")))
        row = scoring.methods(**{"by-source": row})
        out = row if out is None else out.unionByName(row)
    return scoring.micro(out).select("method", "scored_member_count", "true_positive", "false_positive", "false_negative", "recall")


@query("SELECT count(*) AS known_count, count(*) FILTER (f) AS discovered_count, count(*) FILTER (NOT f) AS missed_count, count(*) FILTER (f AND NOT w AND d) AS failed_decode_count, count(*) FILTER (f AND w) AS complete_body_count, round(count(*) FILTER (f AND w) / count(*), 4) AS complete_body_coverage, count(*) FILTER (f AND c_custkey % 8 = 0) AS address_only_count, count(*) FILTER (f AND c_custkey % 8 = 1) AS incomplete_count FROM (SELECT c_custkey, c_custkey % 5 <> 0 AS f, c_custkey % 3 <> 0 AS w, c_custkey % 2 = 0 AS d FROM customer)")
def discovery_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    known = tables.read(spark, sf_dir, "customer").select(k.alias("id"), k)
    universe = known.where(k % 5 != 0).select("id", F.when(k % 8 == 0, "address-only").when(k % 8 == 1, "incomplete").otherwise("complete").alias("analysis_status"))
    return scoring.discovery(known, universe, known.select("id", (k % 3 != 0).alias("complete_decode"), F.when(k % 2 == 0, "decode_gap").otherwise("other").alias("failure_reason")))


@query("WITH e AS (SELECT DISTINCT l_partkey % 200 AS part, 's' || l_suppkey AS id, s_nationkey AS nat FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_quantity > 49) SELECT DISTINCT a.id AS first, b.id AS second, 'duplicate' AS label FROM e a JOIN e b ON a.part = b.part AND a.nat = b.nat AND a.id < b.id")
def neutral_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a nation (origin) that share a part (identity)."""
    line, s = tables.read(spark, sf_dir, "lineitem").where("l_quantity > 49"), tables.read(spark, sf_dir, "supplier")
    link = line.join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.concat(F.lit("s"), "l_suppkey").alias("id")).agg(F.collect_set((F.col("l_partkey") % 200).cast("string")).alias("identities"), F.collect_set(F.col("s_nationkey").cast("string")).alias("origins"))
    return scoring.neutral_pairs(link, link)


@query("WITH seen AS (SELECT doc_id AS member, quality::VARCHAR AS o FROM labels) SELECT member, CASE WHEN d.doc_id IS NULL OR member % 4 = 0 THEN 'unknown' WHEN contains(source || ':' || (doc_id % 2), o) THEN 'correct' ELSE 'incorrect' END AS verdict FROM seen LEFT JOIN documents d ON d.doc_id = member")
def label_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("member"), F.when(F.col("doc_id") % 4 != 0, F.array(F.concat("source", F.lit(":"), F.col("doc_id") % 2))).alias("names"))
    return scoring.label_verdicts(catalog._seeds(spark, sf_dir), d).select("member", "verdict")


# checks and payloads


@query("""
WITH q AS (SELECT o_custkey AS first, o_orderkey AS second, o_orderpriority AS p FROM orders)
SELECT first, second, CASE WHEN first >= second THEN 'not canonical' WHEN p LIKE '1%' THEN 'unknown decision' WHEN p LIKE '2%' THEN 'unknown source' END AS fault FROM q WHERE first >= second OR p LIKE '1%' OR p LIKE '2%'""")
def decision_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, p = tables.read(spark, sf_dir, "orders"), F.col("o_orderpriority")
    rows = o.select(F.col("o_custkey").alias("first"), F.col("o_orderkey").alias("second"), F.when(p.startswith("1"), "maybe").otherwise("match").alias("decision"), F.when(p.startswith("2"), "guess").otherwise("candidate").alias("source"))
    return validate.decision_faults(rows)


@query("WITH q AS (SELECT page_id AS address, CASE page_id % 4 WHEN 0 THEN 'rumour' WHEN 1 THEN 'direct-flirt' WHEN 2 THEN 'propagated-wrapper' ELSE 'cleanup-heuristic' END AS evidence FROM pages) SELECT 'm' || address AS member, CASE WHEN address % 4 = 0 THEN 'unknown evidence' WHEN address % 4 = 3 THEN 'bucket against evidence' ELSE 'seedable against evidence' END AS fault FROM q WHERE address % 4 IN (0, 3) OR (address % 4 = 1) <> (address % 8 = 1)")
def label_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("page_id")
    rows = tables.read(spark, sf_dir, "pages").select(F.concat(F.lit("m"), a).alias("member"), a.alias("address"), F.when(a % 4 == 0, "rumour").when(a % 4 == 1, "direct-flirt").when(a % 4 == 2, "propagated-wrapper").otherwise("cleanup-heuristic").alias("evidence"), F.when(a % 4 == 2, "propagated_wrappers").otherwise("matches").alias("bucket"), (a % 8 == 1).alias("seedable"))
    return validate.label_faults(rows)


@query("WITH c AS (SELECT s_suppkey AS member, 'o' || s_nationkey AS origin FROM supplier UNION ALL SELECT s_suppkey, 'x' FROM supplier WHERE s_suppkey % 6 = 0), a AS (SELECT c_custkey AS member, c_custkey % 2 = 0 AS good FROM customer WHERE c_custkey < 60) SELECT member, CASE WHEN n IS NULL THEN 'alias of no member' WHEN n > 1 THEN 'repeated' ELSE 'alias against origin' END AS fault FROM (SELECT member, count(*) AS n FROM c GROUP BY member) FULL JOIN a USING (member) WHERE n IS NULL OR n > 1 OR NOT good")
def catalog_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = tables.read(spark, sf_dir, "supplier"), tables.read(spark, sf_dir, "customer").where("c_custkey < 60")
    rows = s.select(F.col("s_suppkey").alias("member"), F.concat(F.lit("o"), "s_nationkey").alias("origin")).unionByName(s.where("s_suppkey % 6 = 0").select(F.col("s_suppkey").alias("member"), F.lit("x").alias("origin")))
    own = s.select(F.col("s_suppkey").alias("c_custkey"), F.concat(F.lit("o"), "s_nationkey").alias("_o"))
    alias = c.select("c_custkey").join(own, "c_custkey", "left").select(F.col("c_custkey").alias("member"), F.when(F.col("c_custkey") % 2 == 0, F.array(F.coalesce("_o", F.lit("z")), F.lit("y"))).otherwise(F.array(F.lit("y"))).alias("origins"))
    return validate.catalog_faults(rows, alias)


@query("WITH q AS (SELECT 'c' || o_custkey AS first, 'o' || o_orderkey AS second, o_totalprice AS p, o_orderkey % 5 AS k FROM orders) SELECT first, second, CASE WHEN first >= second THEN 'not canonical' WHEN k = 0 THEN 'unknown view' WHEN k = 1 THEN 'score out of range' WHEN k = 2 THEN 'rank out of range' ELSE 'reasons differ from views' END AS fault FROM q WHERE k < 4")
def candidate_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 5
    o = tables.read(spark, sf_dir, "orders")
    view = F.when(k == 0, "odd").otherwise("token")
    found = F.struct(F.when(k == 1, 1.5).otherwise(0.5).alias("score"), F.when(k == 2, 99).otherwise(1).alias("rank"))
    rows = o.select(F.concat(F.lit("c"), "o_custkey").alias("first"), F.concat(F.lit("o"), "o_orderkey").alias("second"), F.create_map(view, found).alias("views"), F.array(F.when(k == 3, "cfg_top_k").otherwise(F.concat(view, F.lit("_top_k")))).alias("reasons"))
    ids = rows.select(F.col("first").alias("id")).union(rows.select("second"))
    return validate.candidate_faults(rows, ids, ("token",), 16)


@query("SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.duplicates(tables.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


@query("WITH x AS (SELECT c_custkey AS k, c_nationkey AS v FROM customer), y AS (SELECT c_custkey AS k, c_nationkey + CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END AS v FROM customer WHERE c_custkey % 11 <> 0) SELECT k, v, 'given' AS _side FROM (FROM x EXCEPT ALL FROM y) UNION ALL SELECT k, v, 'derived' FROM (FROM y EXCEPT ALL FROM x)")
def table_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = tables.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("v"))
    return validate.differences(x, x.where("k % 11 <> 0").withColumn("v", F.col("v") + F.when(F.col("k") % 10 == 0, 1).otherwise(0)))


@query("SELECT 'FUN_' || printf('%08x', user_id::BIGINT * 16 + 1048576) AS id, '0x' || printf('%x', user_id::BIGINT * 16) AS source, '0x' || printf('%x', user_id::BIGINT * 16 + 4) AS angr_targets, NULL::VARCHAR AS filter_reason, count(*) AS n FROM events GROUP BY user_id")
def raw_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers by address, with the targets of the flow analysis turned back from ids."""
    a = F.col("user_id").cast("long") * 16
    none = F.lit(None).cast("string")
    t = tables.read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("callsite")).select(
        S.function_id(a).alias("kind"), S.hex_address(a).alias("source_address"), "callsite", none.alias("target_address"), none.alias("status"), none.alias("operand_kind"), none.alias("resolver"), none.alias("confidence"), F.array(S.function_id(a + 4)).alias("angr_targets")
    )
    return payloads.raw_graph_view(t).select(F.col("kind").alias("id"), "source", F.array_join("angr_targets", ",").alias("angr_targets"), "filter_reason", F.col("callsite").alias("n"))


@query("SELECT n_nationkey AS id, n_name AS kind, n_regionkey AS size FROM nation")
def shown_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the discovery stage may show of functions that carry a label."""
    n = tables.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("kind"), F.col("n_regionkey").alias("size"), F.col("n_name").alias("label"), F.col("n_comment").alias("name")) if "n_comment" in tables.read(spark, sf_dir, "nation").columns else tables.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("kind"), F.col("n_regionkey").alias("size"), F.col("n_name").alias("label"))
    return validate.assert_label_free(payloads.project(n, "discovery"), "discovery")


@query("SELECT s_suppkey AS id, (s_suppkey % 3)::BIGINT AS opaque_indirect_jumps FROM supplier")
def opaque_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = tables.read(spark, sf_dir, "supplier").select(k.cast("string").alias("id"), (k % 3).cast("long").alias("opaque_indirect_jump_count"), F.when(k % 2 == 0, k % 3).cast("long").alias("opaque_indirect_jumps"))
    return payloads.opaque_alias(rows).select(F.col("id").cast("long").alias("id"), "opaque_indirect_jumps")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, user_id AS src, event_id % 7 AS dst, count(*) AS count FROM events GROUP BY ALL")
def edge_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.read(spark, sf_dir, "events").select("ts", F.col("user_id").alias("source"), (F.col("event_id") % 7).alias("target"))
    return windows.edge_counts(e, "1 hour", "1 hour")
