"""Queries over the driver's tables, each with the SQL that says the same where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions import names
from kinweave.functions import scalars as S
from kinweave.operators import bodies, discovery, families, graph, grouping, labels, onepass, profiles, retrieval, scoring, similarity, validate
from kinweave.sources import bindings, tables
from kinweave.streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TOP = 16


def query(sql: str | None = None, name: str | None = None):
    """Registers a function as a query of its name, with its SQL."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


# profiles and retrieval

TOKENS = bindings.INSTRUCTIONS.rstrip() + """,
seq AS (SELECT *, lead(m, 1) OVER w AS m2, lead(m, 2) OVER w AS m3 FROM ins WINDOW w AS (PARTITION BY id ORDER BY pos)),
feats AS (
  SELECT id, 0 AS kind, m AS key, count(*) AS n FROM ins GROUP BY ALL
  UNION ALL SELECT DISTINCT id, 1, concat_ws(' ', m, m2, m3), 1 FROM seq WHERE m3 IS NOT NULL OR pos = 0
  UNION ALL SELECT id, 2, op1 || ',' || op2, count(*) FROM ins GROUP BY ALL
  UNION ALL SELECT id, 3, CASE WHEN k = 0 THEN 'int:zero' WHEN k = 1 THEN 'int:one' WHEN abs(k) < 256 THEN 'int:small' ELSE 'int:large' END, count(*) FROM ins WHERE k IS NOT NULL GROUP BY ALL)
"""

#: Jaccard of each kind for each two ids, by shared keys.
PAIRED = """
tot AS (SELECT id, kind, sum(n) AS t FROM feats GROUP BY ALL),
shared AS (SELECT a.id AS s, b.id AS t, a.kind, sum(least(a.n, b.n)) AS x FROM feats a JOIN feats b ON a.kind = b.kind AND a.key = b.key AND a.id <> b.id GROUP BY ALL),
jac AS (
  SELECT a.id AS s, b.id AS t, k.kind, CASE WHEN coalesce(ta.t, 0) + coalesce(tb.t, 0) = 0 THEN 1.0 ELSE coalesce(x, 0)::DOUBLE / (coalesce(ta.t, 0) + coalesce(tb.t, 0) - coalesce(x, 0)) END AS j
  FROM (SELECT DISTINCT id FROM feats) a JOIN (SELECT DISTINCT id FROM feats) b ON a.id <> b.id CROSS JOIN (SELECT unnest(range(4)) AS kind) k
  LEFT JOIN tot ta ON ta.id = a.id AND ta.kind = k.kind LEFT JOIN tot tb ON tb.id = b.id AND tb.kind = k.kind
  LEFT JOIN shared ON shared.s = a.id AND shared.t = b.id AND shared.kind = k.kind)
"""


def _ranked(score: str) -> str:
    return f"""SELECT view, source, target, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, target) AS rank FROM ({score}) WHERE score > 0) WHERE rank <= {TOP}"""


TOKEN_SCORE = "SELECT 'token' AS view, s AS source, t AS target, round(sum(j) / 4, 9) AS score FROM jac GROUP BY s, t"


@query("WITH " + TOKENS + "SELECT id, CAST(kind AS INTEGER) AS kind, key, CAST(n AS BIGINT) AS n FROM feats")
def token_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.token_features(bindings.instructions(spark, sf_dir))


def _features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(instructions, their token features), both written once."""
    ins = tables.keep(bindings.instructions(spark, sf_dir), "instructions")
    return ins, tables.keep(profiles.token_features(ins), "features")


def _token_search(spark: SparkSession, sf_dir: str, given: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    ins, features = given or _features(spark, sf_dir)
    return retrieval.top_k(profiles.token_profiles(bindings.sizes(ins), features), retrieval.TOKEN, TOP, digits=9)


@query("WITH " + TOKENS + "," + PAIRED + _ranked(TOKEN_SCORE))
def token_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _token_search(spark, sf_dir).withColumn("score", F.round("score", 6))


@query("WITH " + bindings.INSTRUCTIONS + r"""
SELECT id, sha256('[' || string_agg('"' || m || '|' || op1 || ',' || op2 || '|' || CASE WHEN k IS NULL THEN '-' WHEN k = 0 THEN 'int:zero' WHEN k = 1 THEN 'int:one' ELSE 'int:small' END || '|'
  || CASE flow WHEN 'conditional_branch' THEN 'conditional' WHEN 'local_jump' THEN 'jump' WHEN 'external_jump' THEN 'jump' ELSE flow END || '"', ',' ORDER BY pos) || ']') AS exact_token_hash
FROM ins GROUP BY id""")
def token_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.token_hashes(bindings.instructions(spark, sf_dir))


BLOCKS = bindings.INSTRUCTIONS.rstrip() + """,
aimed AS (SELECT DISTINCT id, target AS pos FROM ins WHERE flow IN ('conditional_branch', 'local_jump')),
led AS (
  SELECT ins.*, coalesce(lag(flow) OVER (PARTITION BY ins.id ORDER BY ins.pos) IN ('conditional_branch', 'local_jump', 'external_jump', 'return'), true) OR aimed.pos IS NOT NULL AS leader
  FROM ins LEFT JOIN aimed ON aimed.id = ins.id AND aimed.pos = ins.pos),
numbered AS (SELECT *, sum(leader::INT) OVER (PARTITION BY id ORDER BY pos) - 1 AS b FROM led),
blk AS (
  SELECT id, b, 'B' || b AS label, min(pos) AS start_offset, count(*) AS n_instructions, arg_max(flow, pos) AS last_flow, arg_max(target, pos) AS last_target, max(pos) + 1 AS end_offset
  FROM numbered GROUP BY id, b)
"""


def _blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ins = bindings.instructions(spark, sf_dir)
    return ins, bodies.blocks(ins, bindings.sizes(ins))


@query("WITH " + BLOCKS + "SELECT id, label, start_offset, end_offset, n_instructions, last_flow FROM blk")
def cfg_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _blocks(spark, sf_dir)[1]
    return found.select("id", "label", F.col("start_offset").cast("long"), F.col("end_offset").cast("long"), "n_instructions", "last_flow")


EDGES = BLOCKS.rstrip() + """,
sizes AS (SELECT id, max(end_offset) AS size FROM blk GROUP BY id),
wanted AS (
  SELECT id, label AS source, 'conditional_target' AS kind, last_target AS at, true AS always FROM blk WHERE last_flow = 'conditional_branch'
  UNION ALL SELECT id, label, 'fallthrough', end_offset, last_flow = 'conditional_branch' FROM blk WHERE last_flow NOT IN ('local_jump', 'external_jump', 'return')
  UNION ALL SELECT id, label, 'direct_jump', last_target, true FROM blk WHERE last_flow = 'local_jump'
  UNION ALL SELECT id, label, 'external_exit', NULL, true FROM blk WHERE last_flow = 'external_jump'),
edg AS (
  SELECT DISTINCT w.id, source, coalesce(blk.label, 'EXIT') AS target, kind FROM wanted w LEFT JOIN blk ON blk.id = w.id AND w.at >= blk.start_offset AND w.at < blk.end_offset WHERE always OR blk.label IS NOT NULL)
"""


@query("WITH " + EDGES + "SELECT id, source, target, kind FROM edg")
def cfg_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bodies.cfg_edges(_blocks(spark, sf_dir)[1])


ROLES = EDGES.rstrip() + """,
inner_edges AS (SELECT * FROM edg WHERE target <> 'EXIT'),
degrees AS (
  SELECT blk.id, blk.label, n_instructions, last_flow, (SELECT count(*) FROM inner_edges e WHERE e.id = blk.id AND e.target = blk.label) AS i, (SELECT count(*) FROM inner_edges e WHERE e.id = blk.id AND e.source = blk.label) AS o FROM blk)
"""


COMPOSITE_SCORE = """
SELECT 'composite' AS view, s AS source, t AS target, round((2 * least(a.n, b.n)::DOUBLE / greatest(a.n, b.n) + least(a.k, b.k)::DOUBLE / greatest(a.k, b.k) + j) / 5, 9) AS score
FROM (SELECT s, t, sum(j) AS j FROM jac WHERE kind < 2 GROUP BY s, t) JOIN shape a ON a.id = s JOIN shape b ON b.id = t"""
SHAPE = "shape AS (SELECT i.id, i.n, k FROM (SELECT id, count(*) AS n FROM ins GROUP BY id) i JOIN (SELECT id, count(*) AS k FROM blk GROUP BY id) USING (id))"
BOTH = BLOCKS.rstrip() + "," + TOKENS[len(bindings.INSTRUCTIONS.rstrip()) + 1 :].rstrip() + "," + PAIRED.rstrip() + "," + SHAPE


def _composite(spark: SparkSession, sf_dir: str, given: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    ins, features = given or _features(spark, sf_dir)
    found = bodies.blocks(ins, bindings.sizes(ins))
    shape = bindings.sizes(ins).join(found.groupBy("id").agg(F.count("*").alias("block_count")), "id").withColumn("instruction_count", F.col("size"))
    return retrieval.top_k(profiles.cheap_profiles(shape, features), retrieval.COMPOSITE, TOP, digits=9)


@query("WITH " + BOTH + " " + _ranked(COMPOSITE_SCORE))
def composite_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _composite(spark, sf_dir).withColumn("score", F.round("score", 6))


@query("WITH " + BOTH + f""",
found AS ({_ranked(TOKEN_SCORE)} UNION ALL {_ranked(COMPOSITE_SCORE)}),
per AS (SELECT least(source, target) AS first, greatest(source, target) AS second, view, max(score) AS score, min(rank) AS rank FROM found GROUP BY ALL)
SELECT first, second, count(*)::INTEGER AS n_views, string_agg(view || '_top_k', ',' ORDER BY view) AS reasons, max(score) AS best, min(rank) AS best_rank FROM per GROUP BY ALL HAVING count(*) >= 2""")
def view_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that both the token and the composite view choose."""
    given = _features(spark, sf_dir)
    both = retrieval.unite(_token_search(spark, sf_dir, given), _composite(spark, sf_dir, given))
    chosen = retrieval.consensus(both, 2)
    found = F.map_values("views")
    return chosen.select("first", "second", F.size("views").alias("n_views"), F.array_join("reasons", ",").alias("reasons"), F.round(F.array_max(F.transform(found, lambda x: x["score"])), 6).alias("best"), F.array_min(F.transform(found, lambda x: x["rank"])).alias("best_rank"))


@query()
def multiview_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token, composite and control-flow views united; tests hold each view against a plain one."""
    found = onepass.body_profiles(bindings.instructions(spark, sf_dir))
    views = (retrieval.TOKEN, retrieval.COMPOSITE, retrieval.CFG)
    both = retrieval.unite(*(retrieval.top_k(onepass.profiles(found, view.name), view, TOP, digits=9) for view in views))
    return both.select("first", "second", F.size("views").alias("n_views"), F.array_join("reasons", ",").alias("reasons"))


# call graph and relation


@query("WITH " + bindings.RELATION + "SELECT src, dst, n AS count FROM edges")
def call_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bindings.relation(spark, sf_dir)[1]


@query("WITH " + bindings.RELATION + """
SELECT id, role, CASE WHEN role = 'context-only' THEN 'context' WHEN id IN (SELECT src FROM edges WHERE src <> dst) OR id IN (SELECT dst FROM edges WHERE src <> dst) THEN 'member' ELSE 'abstain' END AS relation_status FROM nodes""")
def relation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = bindings.relation(spark, sf_dir)
    return discovery.relation_status(nodes, edges).select("id", "role", "relation_status")


COLOURS = bindings.RELATION.rstrip() + """,
inner_edges AS (SELECT src, dst, n FROM edges WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)),
r0 AS (SELECT id, is_member, (SELECT count(*) FROM inner_edges WHERE src = id) = 0 AS sink, CASE WHEN is_member THEN 'member:0:' || (SELECT count(*) FROM inner_edges WHERE src = id) ELSE 'anchor:' || anchor END AS c FROM nodes)
"""


def _round(k: int) -> str:
    return f"""
a{k} AS (
  SELECT id, string_agg(side || c || '*' || n, ',' ORDER BY side, c) AS s FROM (
    SELECT src AS id, 'o' AS side, c, sum(n) AS n FROM inner_edges JOIN r{k - 1} ON r{k - 1}.id = dst GROUP BY ALL
    UNION ALL SELECT dst, 'i', b.c, sum(n) FROM inner_edges JOIN r{k - 1} b ON b.id = src JOIN r{k - 1} t ON t.id = dst AND t.sink GROUP BY ALL) GROUP BY id),
r{k} AS (SELECT r.id, is_member, sink, md5(c || coalesce(s, '')) AS c FROM r{k - 1} r LEFT JOIN a{k} USING (id))"""


def _clusters_sql(k: int) -> str:
    return f"SELECT {k} AS round, 'C' || dense_rank() OVER (ORDER BY least_id) AS cluster, id FROM (SELECT id, min(id) OVER (PARTITION BY c) AS least_id FROM r{k} WHERE is_member)"


@query("WITH " + bindings.RELATION + """,
named AS (SELECT id, coalesce(anchor, role) AS c FROM nodes)
SELECT coalesce(o.id, i.id) AS id, o.s AS out_signature, i.s AS in_signature FROM
  (SELECT src AS id, string_agg(coalesce(c, 'external') || '*' || n, ',' ORDER BY coalesce(c, 'external') || '*' || n) AS s FROM edges LEFT JOIN named ON named.id = dst GROUP BY src) o
  FULL JOIN (SELECT dst AS id, string_agg(coalesce(c, 'external') || '*' || n, ',' ORDER BY coalesce(c, 'external') || '*' || n) AS s FROM edges LEFT JOIN named ON named.id = src GROUP BY dst) i ON o.id = i.id""")
def call_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = bindings.relation(spark, sf_dir)
    found = graph.signatures(edges, nodes.select("id", F.coalesce("anchor", "role").alias("colour")))
    text = lambda c: F.array_join(F.array_sort(F.transform(c, lambda x: F.concat_ws("*", x["descriptor"], x["count"]))), ",").alias(c)
    return found.select("id", text("out_signature"), text("in_signature"))


@query("""
WITH a AS (SELECT p_partkey AS address, CASE WHEN p_size < 10 THEN 0 ELSE p_size END AS size, p_name AS name FROM part),
b AS (SELECT l_partkey AS address, CAST(max(l_quantity) AS BIGINT) AS size FROM lineitem GROUP BY l_partkey)
SELECT coalesce(a.address, b.address) AS address, CASE WHEN a.address IS NULL THEN b.size WHEN a.size <= 0 AND b.size > 0 THEN b.size ELSE a.size END AS size, coalesce(name, 'line') AS name,
  CASE WHEN b.address IS NULL THEN 'part' WHEN a.address IS NULL THEN 'line+part' ELSE 'part+line' END AS boundary_source
FROM a FULL JOIN b ON a.address = b.address""")
def merged_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, line = tables.read(spark, sf_dir, "part"), tables.read(spark, sf_dir, "lineitem")
    first = part.select(F.col("p_partkey").alias("address"), F.when(F.col("p_size") < 10, 0).otherwise(F.col("p_size")).cast("long").alias("size"), F.col("p_name").alias("name"), F.lit("part").alias("boundary_source"), F.lit("fcn").alias("kind"))
    second = line.groupBy(F.col("l_partkey").alias("address")).agg(F.max("l_quantity").cast("long").alias("size")).select("address", "size", F.lit("line").alias("name"), F.lit("line+part").alias("boundary_source"), F.lit("fcn").alias("kind"))
    return discovery.merge_sources(first, second).select("address", "size", "name", "boundary_source")


@query("""
WITH spans AS (SELECT c_custkey * 100 AS start, CAST(floor(abs(c_acctbal)) AS BIGINT) AS size FROM customer)
SELECT o_orderkey AS point, coalesce((SELECT max(start) FROM spans WHERE start = o_orderkey), (SELECT min(start) FROM spans WHERE size > 0 AND start <= o_orderkey AND o_orderkey < start + size)) AS start,
FROM orders""")
def located_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval that holds each order's key, by the bucketed range join."""
    spans = tables.read(spark, sf_dir, "customer").select((F.col("c_custkey") * 100).alias("start"), F.floor(F.abs("c_acctbal")).cast("long").alias("size"))
    return discovery.locate(tables.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("point")), spans, "point", "start", "size", ["start"])


SITES = bindings.TRANSFERS.rstrip() + """,
latest AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY source, callsite ORDER BY seq DESC) AS r FROM tr) WHERE r = 1),
classified AS (SELECT l.*, CASE WHEN target IS NULL THEN 'unresolved' WHEN target IN (SELECT DISTINCT user_id FROM events) THEN 'resolved' ELSE 'unmapped' END AS status FROM latest l),
possible AS (SELECT source, callsite, list_sort(list(DISTINCT target)) AS targets FROM tr WHERE target IS NOT NULL AND kind = 'call' GROUP BY ALL),
sites AS (
  SELECT c.source, c.callsite, c.kind, c.operand_kind, c.seq, coalesce(len(targets), 0) AS n, status = 'unresolved' AND operand_kind IN ('memory', 'register') AS open, targets, status, target FROM classified c LEFT JOIN possible USING (source, callsite))
"""


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = bindings.transfers(spark, sf_dir)
    functions = t.select(F.col("source").alias("address")).distinct()
    latest = discovery.classify_targets(discovery.latest_per_site(t, "seq"), functions)
    possible = t.where("target IS NOT NULL AND kind = 'call'").select("source", "callsite", "target")
    return discovery.resolve_indirect(latest, possible, t.where("kind = 'tail-call'").select("source", "callsite"))


@query("WITH " + SITES + """
SELECT source, callsite, kind, CASE WHEN open AND n = 1 THEN 'resolved' ELSE status END AS status, CASE WHEN open AND n = 1 THEN targets[1] ELSE target END AS target,
  CASE WHEN NOT open THEN NULL WHEN n = 1 THEN 'resolved-singleton' WHEN n > 1 THEN 'multiple-targets' WHEN EXISTS (SELECT 1 FROM tr WHERE tr.source = sites.source AND tr.callsite = sites.callsite AND tr.kind = 'tail-call') THEN 'unresolvable-target' ELSE 'not-seen' END AS resolution
FROM sites""")
def resolved_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).select("source", "callsite", "kind", "status", "target", "resolution")


@query("WITH " + SITES + """
SELECT CASE WHEN open AND n > 1 THEN 'ambiguous' WHEN (CASE WHEN open AND n = 1 THEN 'resolved' ELSE status END) = 'resolved' THEN 'resolved' ELSE 'unresolved' END AS state, kind, count(*) AS n FROM sites GROUP BY ALL""")
def slot_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _resolved(spark, sf_dir)
    state = families.transfer_state(F.coalesce(F.size("possible_targets"), F.lit(0)), F.col("status"), F.col("target"), F.lit(True))
    return r.groupBy(state.alias("state"), "kind").agg(F.count("*").alias("n"))


SLOTS = bindings.INSTRUCTIONS.rstrip() + ", base AS (SELECT 's' || s_suppkey AS id, s_suppkey * 100000 AS address FROM supplier)"


@query("WITH " + SLOTS + """
SELECT ins.id, pos AS \"offset\", 0 AS \"index\", CASE flow WHEN 'call' THEN 'CALL_TARGET' ELSE 'TAIL_CALL_TARGET' END AS kind, CASE WHEN s_acctbal > 0 THEN 'n' || s_nationkey END AS value, CASE WHEN s_acctbal IS NULL THEN 'missing' WHEN s_acctbal > 0 THEN 'resolved' ELSE 'unresolved' END AS state
  FROM ins JOIN base ON base.id = ins.id LEFT JOIN supplier ON s_suppkey = pos WHERE flow IN ('call', 'external_jump')
UNION ALL SELECT id, pos, 1, 'IMMEDIATE_CONSTANT', k::VARCHAR, 'resolved' FROM ins WHERE k IS NOT NULL""")
def slot_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of all bodies; the transfer at a callsite is that of the supplier whose number is the offset."""
    ins, supplier = bindings.instructions(spark, sf_dir), tables.read(spark, sf_dir, "supplier")
    functions = supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), (F.col("s_suppkey") * 100000).alias("address"))
    calls = ins.where(F.col("control_flow").isin("call", "external_jump")).join(functions, "id").join(supplier.select(F.col("s_suppkey").alias("offset"), "s_nationkey", "s_acctbal"), "offset")
    good = F.col("s_acctbal") > 0
    transfers = calls.select(F.col("address").alias("source"), (F.col("address") + F.col("offset")).alias("callsite"), F.lit("call").alias("kind"), F.when(good, "resolved").otherwise("unresolved").alias("status"), F.when(good, F.concat(F.lit("n"), "s_nationkey")).alias("target"), F.lit(1).alias("n_targets"))
    return families.slots(ins, functions, transfers).withColumn("offset", F.col("offset").cast("long"))


# pricing, components, decisions

STARS = bindings.INSTRUCTIONS.rstrip() + """,
grp AS (SELECT 's' || s_suppkey AS id, s_nationkey || CASE WHEN s_acctbal >= 0 THEN '+' ELSE '-' END AS g FROM supplier),
hub AS (SELECT g, min(id) AS hub FROM grp GROUP BY g),
stars AS (SELECT hub AS first, id AS second FROM grp JOIN hub USING (g) WHERE id <> hub),
len AS (SELECT id, count(*) AS n FROM ins GROUP BY id),
cells AS (SELECT first, second, coalesce(a.n, 0) * coalesce(b.n, 0) AS cells FROM stars LEFT JOIN len a ON a.id = first LEFT JOIN len b ON b.id = second)
"""


def _stars(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(ids of suppliers, pairs that tie those of one nation and one sign of balance to the first of them)."""
    s = tables.read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat("s_nationkey", F.when(F.col("s_acctbal") >= 0, "+").otherwise("-")).alias("g"))
    hub = s.groupBy("g").agg(F.min("id").alias("first"))
    return s.select("id"), s.join(hub, "g").where("id <> first").select("first", F.col("id").alias("second"))


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bindings.instructions(spark, sf_dir).groupBy("id").agg(F.count("*").alias("n"))


@query("WITH " + STARS + """
SELECT count(*) AS pair_count, coalesce(sum(cells), 0)::BIGINT AS alignment_cells, coalesce(max(cells), 0) AS alignment_cells_max,
  (list_sort(list(cells)))[least((0.5 * (count(*) - 1) + 0.5)::INT, count(*) - 1) + 1] AS alignment_cells_median,
  (list_sort(list(cells)))[least(floor(0.99 * (count(*) - 1) + 0.5)::INT, count(*) - 1) + 1] AS alignment_cells_p99 FROM cells""".replace("(0.5 * (count(*) - 1) + 0.5)::INT", "floor(0.5 * (count(*) - 1) + 0.5)::INT"))
def cost_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.cost_summary(_stars(spark, sf_dir)[1], _lengths(spark, sf_dir))


@query("WITH " + STARS + """,
r AS (SELECT cells, row_number() OVER (ORDER BY cells DESC) AS k FROM cells)
SELECT count(*) AS pair_count, count(*) AS required_comparisons, sum(cells)::BIGINT AS required_alignment_cells, (list_sort(list(cells)))[count(*) // 2 + 1] AS cells_median, max(cells) AS cells_max,
  round(sum(cells) FILTER (k <= 10)::DOUBLE / sum(cells), 4) AS top10_share, round(sum(cells) FILTER (k <= 50)::DOUBLE / sum(cells), 4) AS top50_share, count(*) <= 10000 AND sum(cells) <= 500000000 AS within_budget FROM r""")
def queue_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, pairs = _stars(spark, sf_dir)
    return grouping.price(pairs, _lengths(spark, sf_dir), ids, S.PairPolicy())


CELLS = 3_000_000


@query("WITH " + STARS + f""",
cost AS (
  SELECT min(grp.id) AS component, count(*) AS n_members, count(n) AS n_comparable, count(n) * (count(n) - 1) // 2 AS comparisons, coalesce((sum(n) * sum(n) - sum(n * n)) // 2, 0)::BIGINT AS cells FROM grp LEFT JOIN len USING (id) GROUP BY g)
SELECT *, sum(cells) OVER (ORDER BY cells, comparisons, component) <= {CELLS} AS selected FROM cost""")
def component_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the stars, their closed-form costs, and which fit a ceiling of cells."""
    ids, pairs = _stars(spark, sf_dir)
    members = tables.keep(graph.components(ids, pairs), "components")
    costs = tables.keep(grouping.component_costs(members, _lengths(spark, sf_dir)), "costs")
    return grouping.admit(costs, S.PairPolicy(max_comparisons=None, max_cells=CELLS))


FEATURES = """
f AS (
  SELECT c_custkey AS id, least(abs(c_acctbal) / 9000, 1.0) AS structure_score, CASE c_mktsegment WHEN 'BUILDING' THEN NULL WHEN 'MACHINERY' THEN 0.5 ELSE 1.0 END AS constant_similarity,
    CASE WHEN c_nationkey < 5 THEN NULL WHEN c_nationkey < 8 THEN 0.9 ELSE 1.0 END AS data_reference_similarity, c_nationkey <> 24 AS both_complete, CASE WHEN c_nationkey = 23 THEN 1 ELSE 0 END AS opaque FROM customer)
"""


@query("WITH " + FEATURES + """
SELECT id, CASE WHEN NOT both_complete OR opaque > 0 THEN 'abstain' WHEN structure_score <= 0.3 THEN 'reject'
  WHEN structure_score >= 0.95 AND (constant_similarity IS NOT NULL OR data_reference_similarity IS NOT NULL) AND coalesce(constant_similarity, 1) >= 1 AND coalesce(data_reference_similarity, 1) >= 1 THEN 'match' ELSE 'unknown' END AS decision,
  CASE WHEN constant_similarity IS NULL AND data_reference_similarity IS NULL THEN -999 ELSE round(least(structure_score - 0.95, coalesce(constant_similarity, 9) - 1, coalesce(data_reference_similarity, 9) - 1), 6) END AS margin FROM f""")
def pair_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions and margins over given features."""
    c = tables.read(spark, sf_dir, "customer")
    seg, n = F.col("c_mktsegment"), F.col("c_nationkey")
    f = c.select(
        F.col("c_custkey").alias("id"), F.least(F.abs("c_acctbal") / 9000, F.lit(1.0)).alias("structure_score"), F.when(seg == "BUILDING", None).when(seg == "MACHINERY", 0.5).otherwise(1.0).alias("constant_similarity"),
        F.when(n < 5, None).when(n < 8, 0.9).otherwise(1.0).alias("data_reference_similarity"), (n != 24).alias("both_complete"), F.when(n == 23, 1).otherwise(0).alias("opaque_indirect_jumps"),
    )
    out = grouping.decide(f, S.PairPolicy(structure_reject=0.3))
    return out.select("id", "decision", F.when(F.col("margin") == float("-inf"), -999.0).otherwise(F.round("margin", 6)).alias("margin"))


def _orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(bodies of orders, pairs of each order with the first of its customer and status)."""
    ins = bindings.instructions(spark, sf_dir, "l_orderkey", "o")
    found = tables.keep(bodies.blocks(ins, bindings.sizes(ins)), "blocks")
    quality = found.groupBy("id").agg(F.lit(True).alias("complete_decode")).join(bodies.opaque_jumps(found), "id")
    whole = tables.keep(bodies.assemble(bindings.sizes(ins), ins, found, bodies.cfg_edges(found), quality), "bodies")
    o = tables.read(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("second"), "o_custkey", "o_orderstatus")
    first = o.groupBy("o_custkey", "o_orderstatus").agg(F.min("second").alias("first"))
    return whole, o.join(first, ["o_custkey", "o_orderstatus"]).where("first <> second").select("first", "second")


@query()
def pair_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirteen measures of pairs of orders by the alignment kernels; tests hold them against a plain version."""
    whole, pairs = _orders(spark, sf_dir)
    found = similarity.metrics(pairs, whole)
    return found.select("first", "second", *(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes[2:]))


@query()
def strict_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders priced, decided and grouped by complete links, under a policy that short bodies can meet."""
    whole, pairs = _orders(spark, sf_dir)
    policy = S.PairPolicy(structure_match=0.6, slot_match=0.5, require_informative_slot=False, max_comparisons=None, max_cells=None)
    status, table, _ = grouping.strict_families(pairs, whole, policy, similarity.features)
    return table if table is not None else spark.createDataFrame([(status,)], "status string")


# axes and rescue

AXES = bindings.FILLED.rstrip() + """,
whole AS (SELECT *, min(id) OVER (PARTITION BY family, off, value) AS g FROM (SELECT *, bool_and(value IS NOT NULL) OVER (PARTITION BY family, off) AS ok FROM filled) WHERE ok),
varying AS (SELECT * FROM (SELECT *, min(g) OVER (PARTITION BY family, off) AS lo, max(g) OVER (PARTITION BY family, off) AS hi FROM whole) WHERE lo <> hi),
shapes AS (SELECT family, off, string_agg(id || '=' || g, ',' ORDER BY id) AS shape FROM varying GROUP BY ALL),
axes AS (SELECT family, shape, min(off) AS off, count(*) AS n_slots, row_number() OVER (PARTITION BY family ORDER BY min(off)) AS axis FROM shapes GROUP BY family, shape),
lab AS (SELECT a.family, CAST(a.axis AS INTEGER) AS axis, v.id, CAST(dense_rank() OVER (PARTITION BY a.family, a.axis ORDER BY v.g) - 1 AS INTEGER) AS label, n_slots FROM axes a JOIN varying v ON v.family = a.family AND v.off = a.off),
cells AS (SELECT x.family, x.axis AS first, y.axis AS second, x.label AS l1, y.label AS l2, count(*) AS c FROM lab x JOIN lab y ON x.family = y.family AND x.id = y.id AND x.axis < y.axis GROUP BY ALL),
cov AS (SELECT family, first, second, count(DISTINCT l1) * count(DISTINCT l2) AS expected, count(*) AS observed, max(c) AS most FROM cells GROUP BY ALL),
fine AS (SELECT family, fine, coarse FROM (SELECT x.family, x.axis AS fine, y.axis AS coarse, x.label, count(DISTINCT y.label) AS n FROM lab x JOIN lab y ON x.family = y.family AND x.id = y.id AND x.axis <> y.axis GROUP BY ALL) GROUP BY ALL HAVING max(n) = 1),
top AS (SELECT DISTINCT family, axis FROM lab WHERE NOT EXISTS (SELECT 1 FROM fine WHERE fine.family = lab.family AND coarse = axis))
"""


def _axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.keep(families.axes(bindings.filled_slots(spark, sf_dir)), "axes")


@query("WITH " + AXES + "SELECT * FROM lab")
def variation_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _axes(spark, sf_dir)


@query("WITH " + AXES + "SELECT family, first, second, expected, observed, expected = observed AS complete, expected = observed AND most = 1 AS bijective FROM cov")
def axis_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.coverage(_axes(spark, sf_dir))


@query("WITH " + AXES + "SELECT family, axis FROM top")
def maximal_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _axes(spark, sf_dir)
    return families.maximal(found, families.refinements(found))


@query("WITH " + AXES + """,
good AS (SELECT family, first, second FROM cov WHERE expected = observed AND most = 1 AND (family, first) IN (SELECT (family, axis) FROM top) AND (family, second) IN (SELECT (family, axis) FROM top)),
fit AS (SELECT * FROM good g WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT family, axis FROM lab) o WHERE o.family = g.family AND axis <> first AND axis <> second
  AND NOT EXISTS (SELECT 1 FROM fine WHERE fine.family = g.family AND coarse = axis AND fine.fine IN (first, second)))),
n AS (SELECT family, count(*) AS n, min({'a': first, 'b': second}) AS p FROM fit GROUP BY family)
SELECT family, CASE WHEN n = 1 THEN p.a END AS first, CASE WHEN n = 1 THEN p.b END AS second, CASE WHEN n = 1 THEN 'unique' WHEN n > 1 THEN 'ambiguous' WHEN family IN (SELECT family FROM good) THEN 'no_pair_explains_every_axis' ELSE 'none' END AS status
FROM (SELECT DISTINCT family FROM lab) LEFT JOIN n USING (family)""")
def axis_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _axes(spark, sf_dir)
    finer = families.refinements(found)
    return families.basis(found, families.coverage(found), finer, families.maximal(found, finer))


@query("WITH " + AXES + "SELECT family, axis, max(n) >= 2 AS supported FROM (SELECT family, axis, s_nationkey < 12 AS fragment, count(DISTINCT label) AS n FROM lab JOIN supplier ON s_suppkey = id GROUP BY ALL) GROUP BY ALL")
def internal_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    fragments = tables.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") < 12).alias("fragment"))
    return families.internal_support(_axes(spark, sf_dir), fragments)


@query("""
WITH s AS (SELECT s_nationkey AS family, s_suppkey AS id, s_acctbal AS x FROM supplier),
p AS (SELECT a.family, a.id, round(1 / (1 + abs(a.x - b.x)), 9) AS score FROM s a JOIN s b ON a.family = b.family AND a.id <> b.id),
m AS (SELECT family, id, round(sum(score) / count(*), 9) AS mean FROM p GROUP BY ALL)
SELECT family, id AS medoid, round(mean, 6) AS mean_similarity FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY mean DESC, id) AS r FROM m) WHERE r = 1""")
def family_medoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables.read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("family"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"))
    a, b = s.select("family", F.col("id").alias("first"), F.col("x").alias("_a")), s.select("family", F.col("id").alias("second"), F.col("x").alias("_b"))
    scores = a.join(b, "family").where("first < second").select("family", "first", "second", F.round(1 / (1 + F.abs(F.col("_a") - F.col("_b"))), 9).alias("score"))
    return families.medoids(scores).withColumn("mean_similarity", F.round("mean_similarity", 6))


# labels and attachment

DOCS = """
fam AS (SELECT source || ':' || (n_chars // 400) AS family_id, doc_id AS id FROM documents),
seed AS (SELECT doc_id AS member, quality::VARCHAR AS origin, toxic::VARCHAR AS owner FROM labels)
"""


def _families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "documents").select(F.concat_ws(":", "source", F.expr("n_chars div 400")).alias("family_id"), F.col("doc_id").alias("id"))


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "labels").select(F.col("doc_id").alias("member"), F.col("quality").cast("string").alias("canonical_origin"), F.col("toxic").cast("string").alias("owner"))


PROPAGATED = DOCS.rstrip() + """,
st AS (
  SELECT family_id, count(*) AS n_members, count(member) AS n_seeds, count(DISTINCT origin || '|' || owner) AS kinds, min(origin) AS o, min(owner) AS w FROM fam LEFT JOIN seed ON member = id GROUP BY family_id),
fams AS (SELECT family_id, CASE WHEN n_seeds = 0 THEN 'no-seed' WHEN kinds > 1 THEN 'conflict' WHEN n_seeds = n_members THEN 'fully-labeled' ELSE 'eligible' END AS status, CASE WHEN kinds = 1 THEN o END AS canonical_origin, CASE WHEN kinds = 1 THEN w END AS owner, n_seeds, n_members FROM st),
given AS (SELECT id AS member, family_id, canonical_origin, owner FROM fam JOIN fams USING (family_id) WHERE status = 'eligible' AND id NOT IN (SELECT member FROM seed))
"""


@query("WITH " + PROPAGATED + "SELECT * FROM fams")
def propagation_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _families(spark, sf_dir)
    return labels.propagate(p, _seeds(spark, sf_dir), p.select("id"))[1]


@query("WITH " + PROPAGATED + "SELECT * FROM given")
def propagated_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _families(spark, sf_dir)
    return labels.propagate(p, _seeds(spark, sf_dir), p.select("id"))[2]


@query("WITH " + PROPAGATED + """
SELECT (SELECT count(*) FROM fam) AS target_member_count, (SELECT count(*) FROM fams) AS family_count, (SELECT count(*) FROM fams WHERE status = 'eligible') AS eligible_family_count, (SELECT count(*) FROM fams WHERE status = 'conflict') AS conflict_family_count,
  (SELECT count(*) FROM seed) AS direct_seed_count, (SELECT count(*) FROM seed WHERE member IN (SELECT id FROM fam)) AS in_universe_count, (SELECT count(*) FROM seed WHERE member NOT IN (SELECT id FROM fam)) AS outside_universe_count,
  (SELECT count(*) FROM seed WHERE member IN (SELECT id FROM fam)) AS in_partition_count, (SELECT count(*) FROM given) AS propagated_member_count""")
def propagation_opportunity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _families(spark, sf_dir)
    return labels.opportunity(*labels.propagate(p, _seeds(spark, sf_dir), p.select("id")), p, p.select("id"))


LABELS = "raw AS (SELECT page_id AS address, CASE WHEN page_id < 100 THEN 'direct-flirt' WHEN page_id < 180 THEN 'propagated-wrapper' ELSE 'cleanup-heuristic' END AS evidence, 'web::' || page_id || '::get' AS name FROM pages)"


@query("WITH " + LABELS + """
SELECT 'FUN_' || printf('%08x', address + 1048576) AS member, address, evidence, evidence = 'direct-flirt' AS seedable, name AS canonical_origin, 'web' AS owner,
  CASE WHEN address NOT IN (SELECT doc_id FROM labels) THEN 'unmatched_addresses' WHEN evidence = 'direct-flirt' THEN 'matches' WHEN evidence = 'propagated-wrapper' THEN 'propagated_wrappers' ELSE 'cleanup_heuristics' END AS bucket FROM raw""")
def label_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("page_id")
    raw = tables.read(spark, sf_dir, "pages").select(a.alias("address"), a.alias("mapped_address"), F.when(a < 100, "direct-flirt").when(a < 180, "propagated-wrapper").otherwise("cleanup-heuristic").alias("evidence"), F.concat(F.lit("web::"), a, F.lit("::get")).alias("name"))
    functions = tables.read(spark, sf_dir, "labels").select(F.col("doc_id").alias("address"))
    return labels.bucket_labels(raw, functions).select("member", "address", "evidence", "seedable", "canonical_origin", "owner", "bucket")


#: Customers' latest line items from suppliers stand for decisions; customers are the candidates, suppliers of a nation and a class of balance the cores.
ATTACH = """
dec AS (
  SELECT DISTINCT 'a' || o_custkey AS first, 'b' || l_suppkey AS second, CASE WHEN l_quantity > 45 THEN 'reject' WHEN l_quantity > 20 THEN 'match' WHEN l_quantity > 10 THEN 'unknown' ELSE 'abstain' END AS decision, CASE WHEN o_orderstatus = 'F' THEN 'candidate' ELSE 'on-demand' END AS source, l_quantity AS q
  FROM (SELECT o_custkey, o_orderstatus, l_suppkey, l_quantity, row_number() OVER (PARTITION BY o_custkey, l_suppkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_quantity) AS r FROM orders JOIN lineitem ON l_orderkey = o_orderkey) WHERE r = 1),
core AS (SELECT 'n' || s_nationkey || ':' || CAST(floor(s_acctbal / 2500) AS BIGINT) AS family_id, 'b' || s_suppkey AS id FROM supplier),
cand AS (SELECT 'a' || c_custkey AS id FROM customer)
"""


def _attachment(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    o, line = tables.read(spark, sf_dir, "orders"), tables.read(spark, sf_dir, "lineitem")
    j = o.select("o_orderkey", "o_custkey", "o_orderstatus").join(line.select("l_orderkey", "l_suppkey", "l_quantity", "l_shipdate", "l_linenumber"), F.col("o_orderkey") == F.col("l_orderkey"))
    w = F.row_number().over(discovery.Window.partitionBy("o_custkey", "l_suppkey").orderBy(F.col("l_shipdate").desc(), "l_orderkey", "l_linenumber", "l_quantity"))
    q = F.col("l_quantity")
    dec = j.withColumn("r", w).where("r = 1").select(F.concat(F.lit("a"), "o_custkey").alias("first"), F.concat(F.lit("b"), "l_suppkey").alias("second"), F.when(q > 45, "reject").when(q > 20, "match").when(q > 10, "unknown").otherwise("abstain").alias("decision"), F.when(F.col("o_orderstatus") == "F", "candidate").otherwise("on-demand").alias("source"))
    core = tables.read(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), "s_nationkey", F.lit(":"), F.floor(F.col("s_acctbal") / 2500)).alias("family_id"), F.concat(F.lit("b"), "s_suppkey").alias("id"))
    cand = tables.read(spark, sf_dir, "customer").select(F.concat(F.lit("a"), "c_custkey").alias("id"))
    return dec, cand, core


@query("WITH " + ATTACH + """,
per AS (SELECT first AS member, family_id, count(*) FILTER (decision = 'match') AS n_support, count(*) FILTER (decision = 'unknown') AS n_unknown, count(*) FILTER (decision = 'abstain') AS n_abstain, count(*) FILTER (decision = 'reject') AS rejects, count(*) FILTER (decision = 'match' AND source = 'candidate') AS proposed, count(*) AS seen FROM dec JOIN core ON core.id = second GROUP BY ALL),
good AS (SELECT *, (SELECT count(*) FROM core WHERE core.family_id = per.family_id) - seen AS n_missing FROM per WHERE rejects = 0 AND proposed > 0),
one AS (SELECT member, count(*) AS n, any_value(family_id) AS f, any_value(n_support) AS s, any_value(n_unknown) AS u, any_value(n_abstain) AS a, any_value(n_missing) AS m, string_agg(family_id, ',' ORDER BY family_id) AS everything FROM good GROUP BY member)
SELECT id, CASE WHEN n = 1 THEN 'attached' WHEN n > 1 THEN 'ambiguous' ELSE 'unassigned' END AS outcome, CASE WHEN n = 1 THEN f END AS family_id, CASE WHEN n = 1 THEN s END AS n_support, CASE WHEN n = 1 THEN u END AS n_unknown, CASE WHEN n = 1 THEN a END AS n_abstain, CASE WHEN n = 1 THEN m END AS n_missing, CASE WHEN n > 1 THEN everything END AS families FROM cand LEFT JOIN one ON member = id""")
def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.attach(*_attachment(spark, sf_dir)).withColumn("families", F.array_join("families", ","))


@query("WITH " + ATTACH + "SELECT first AS member, family_id, count(*) FILTER (decision = 'reject') AS n_rejects FROM dec JOIN core ON core.id = second GROUP BY ALL HAVING count(*) FILTER (decision = 'reject') > 0 AND count(*) FILTER (decision = 'match' AND source = 'candidate') > 0")
def attachment_vetoes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.vetoes(*_attachment(spark, sf_dir))


@query("WITH " + ATTACH + "SELECT DISTINCT m.first, core.id AS second FROM (SELECT DISTINCT first, family_id FROM dec JOIN core ON core.id = second WHERE decision = 'match' AND source = 'candidate') m JOIN core USING (family_id)")
def reachable_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    dec, cand, core = _attachment(spark, sf_dir)
    return labels.cross_pairs(dec.where("decision = 'match' AND source = 'candidate'"), cand, core)


@query("""
WITH fam AS (SELECT 'f' || s_nationkey AS fragment, s_suppkey AS id FROM supplier),
comp AS (SELECT 'f' || n_nationkey AS fragment, n_regionkey AS component FROM nation WHERE 'f' || n_nationkey IN (SELECT fragment FROM fam)),
good AS (SELECT component, string_agg(fragment, '+' ORDER BY fragment) AS family_id FROM comp WHERE component IN (1, 3) GROUP BY component)
SELECT coalesce(family_id, fam.fragment) AS family_id, id, CASE WHEN family_id IS NULL THEN 'strict' ELSE 'rescued' END AS origin FROM fam LEFT JOIN comp USING (fragment) LEFT JOIN good USING (component)""")
def final_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations' suppliers as fragments; the nations of two regions are rescued together."""
    fam = tables.read(spark, sf_dir, "supplier").select(F.concat(F.lit("f"), "s_nationkey").alias("fragment"), F.col("s_suppkey").alias("id"))
    comp = tables.read(spark, sf_dir, "nation").select(F.concat(F.lit("f"), "n_nationkey").alias("fragment"), F.col("n_regionkey").alias("component")).join(fam.select("fragment").distinct(), "fragment", "left_semi")
    verdicts = tables.read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("component"), F.when(F.col("r_regionkey").isin(1, 3), "accepted").otherwise("rejected").alias("status"))
    return families.final_partition(fam, comp, verdicts)


# scores

CONFUSION = """
pred AS (SELECT lang || ':' || (n_chars // 1000) AS g, doc_id AS id FROM documents),
tru AS (SELECT source AS o, doc_id AS id FROM documents),
tp AS (SELECT sum(n * (n - 1) // 2) AS x FROM (SELECT count(*) AS n FROM pred JOIN tru USING (id) GROUP BY g, o)),
pp AS (SELECT sum(n * (n - 1) // 2) AS x FROM (SELECT count(*) AS n FROM pred GROUP BY g)),
tt AS (SELECT sum(n * (n - 1) // 2) AS x FROM (SELECT count(*) AS n FROM tru GROUP BY o)),
c AS (SELECT (SELECT count(*) FROM tru) AS m, tp.x::BIGINT AS tp, (pp.x - tp.x)::BIGINT AS fp, (tt.x - tp.x)::BIGINT AS fn FROM tp, pp, tt)
"""


@query("WITH " + CONFUSION + """
SELECT m AS scored_member_count, tp AS true_positive, fp AS false_positive, fn AS false_negative, m * (m - 1) // 2 - tp - fp - fn AS true_negative, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall,
  round(2 * round(tp / (tp + fp), 4) * round(tp / (tp + fn), 4) / (round(tp / (tp + fp), 4) + round(tp / (tp + fn), 4)), 4) AS f1, 0 AS neutral_pair_total FROM c""")
def pair_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = bindings.truth(spark, sf_dir)
    out = scoring.pair_confusion(bindings.partition(spark, sf_dir), t, t.select("id"))
    return out.drop("duplicate_neutral", "ambiguous_neutral", "unresolved_neutral")


LINK = """
link AS (SELECT o_custkey AS id, list(DISTINCT l_partkey) AS identities, list(DISTINCT o_orderpriority) AS origins FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey),
universe AS (SELECT c_custkey AS id FROM customer)
"""


@query("WITH " + LINK + """
SELECT id, CASE WHEN len(origins) > 1 THEN 'ambiguous' END AS label FROM link WHERE id IN (SELECT id FROM universe) AND len(origins) > 1""")
def neutral_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, line = tables.read(spark, sf_dir, "orders"), tables.read(spark, sf_dir, "lineitem")
    j = o.join(line, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set("l_partkey").alias("identities"), F.collect_set("o_orderpriority").alias("origins"))
    return scoring.neutral_members(j, tables.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")))


@query("SELECT *, upper_bound - newly_correct AS opportunity_gap FROM (WITH " + PROPAGATED + """,
sym AS (SELECT doc_id AS member, source AS name FROM documents),
d AS (SELECT s.member, CASE WHEN name IS NULL THEN 'unknown' WHEN contains(name, origin) THEN 'correct' ELSE 'incorrect' END AS v FROM seed s LEFT JOIN sym USING (member)),
g AS (SELECT s.member, CASE WHEN name IS NULL THEN 'unknown' WHEN contains(name, canonical_origin) THEN 'correct' ELSE 'incorrect' END AS v FROM given s LEFT JOIN sym USING (member))
SELECT (SELECT count(*) FROM d) AS direct_count, (SELECT count(*) FROM d WHERE v = 'correct') AS direct_correct, (SELECT count(*) FROM d WHERE v = 'incorrect') AS direct_incorrect, (SELECT count(*) FROM d WHERE v = 'unknown') AS direct_unknown,
  (SELECT count(*) FROM g) AS propagated_count, (SELECT count(*) FROM g WHERE v = 'correct') AS propagated_correct, (SELECT count(*) FROM g WHERE v = 'incorrect') AS propagated_incorrect, (SELECT count(*) FROM g WHERE v = 'unknown') AS propagated_unknown,
  (SELECT count(*) FROM g WHERE v = 'correct' AND member NOT IN (SELECT member FROM seed)) AS newly_correct,
  (SELECT count(*) FROM documents WHERE source IN (SELECT source FROM documents WHERE doc_id IN (SELECT member FROM seed)) AND doc_id NOT IN (SELECT member FROM seed)) AS upper_bound,
  (SELECT round(count(*) FILTER (v = 'correct') / count(*) FILTER (v <> 'unknown'), 4) FROM d) AS direct_precision, (SELECT round(count(*) / (SELECT count(*) FROM documents), 4) FROM d) AS direct_coverage)""")
def label_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = _families(spark, sf_dir), _seeds(spark, sf_dir)
    given = labels.propagate(p, s, p.select("id"))[2]
    d = tables.read(spark, sf_dir, "documents")
    symbols = d.select(F.col("doc_id").alias("member"), F.array("source").alias("names"))
    return scoring.label_scores(s, given, bindings.truth(spark, sf_dir), symbols, p.select("id"))


CATALOG = PROPAGATED.rstrip() + """,
cat AS (SELECT doc_id AS address, (n_chars // 1000 % 2)::VARCHAR AS origin, '0' AS owner FROM documents),
amb AS (SELECT doc_id AS address FROM documents WHERE lang = 'es'),
dj AS (SELECT s.member AS address, CASE WHEN cat.address IS NULL THEN 'unknown' WHEN s.member IN (SELECT address FROM amb) THEN 'ambiguous' WHEN s.origin = cat.origin AND s.owner = cat.owner THEN 'correct' ELSE 'incorrect' END AS v FROM seed s LEFT JOIN cat ON cat.address = s.member)
"""


@query("SELECT *, round(direct_correct / (direct_correct + direct_incorrect), 6) AS direct_precision, round(direct_correct / evaluable_count, 6) AS direct_coverage FROM (WITH " + CATALOG + "SELECT (SELECT count(*) FROM cat) AS catalog_count, (SELECT count(*) FROM cat WHERE address NOT IN (SELECT address FROM amb)) AS evaluable_count, " + ", ".join(f"(SELECT count(*) FROM dj WHERE v = '{v}') AS direct_{v}" for v in ("correct", "incorrect", "ambiguous", "unknown")) + ")")
def catalog_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.catalog_scores(*_catalog(spark, sf_dir))
    return out.select("catalog_count", "evaluable_count", *(f"direct_{v}" for v in ("correct", "incorrect", "ambiguous", "unknown", "precision", "coverage")))


def _catalog(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    d = tables.read(spark, sf_dir, "documents")
    catalog = d.select(F.col("doc_id").alias("address"), F.expr("CAST(n_chars div 1000 % 2 AS STRING)").alias("origin"), F.lit("0").alias("owner"))
    s, p = _seeds(spark, sf_dir), _families(spark, sf_dir)
    given = labels.propagate(p, s, p.select("id"))[2]
    return catalog, d.where("lang = 'es'").select(F.col("doc_id").alias("address")), s.withColumnRenamed("member", "address"), given.withColumnRenamed("member", "address")


@query("WITH " + CATALOG + """
SELECT origin, count(*) FILTER (s.member IS NOT NULL AND s.origin2 = origin AND s.owner2 = owner) AS known, count(*) FILTER (s.member IS NULL) AS unknown, known * unknown AS pairs
FROM cat LEFT JOIN (SELECT member, origin AS origin2, owner AS owner2 FROM seed) s ON s.member = address WHERE address NOT IN (SELECT address FROM amb) GROUP BY origin HAVING known > 0 AND unknown > 0""")
def propagation_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, aliases, direct, _ = _catalog(spark, sf_dir)
    return scoring.propagation_bound(catalog, aliases, direct)


# scalars


@query(r"""
WITH o AS (
  SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber WHEN 1 THEN 'dword ptr [rip + ' || l_partkey || ']' WHEN 2 THEN 'qword ptr [rip - 0x' || printf('%x', l_partkey) || ']' WHEN 3 THEN '0x' || printf('%x', l_partkey * 1000) WHEN 4 THEN '-' || l_partkey WHEN 5 THEN 'xmmword ptr [rsp + 8]' WHEN 6 THEN '0' || l_partkey ELSE 'byte ptr [rax]' END AS t FROM lineitem)
SELECT t AS operand, CASE WHEN regexp_full_match(t, '0x[0-9a-f]+') THEN CAST(t AS BIGINT) WHEN regexp_full_match(t, '[+-]?(0+|[1-9][0-9]*)') THEN CAST(t AS BIGINT) END::DECIMAL(20, 0) AS number,
  CASE WHEN t LIKE 'dword%' THEN 32 WHEN t LIKE 'qword%' THEN 64 WHEN t LIKE 'xmmword%' THEN 128 WHEN t LIKE 'byte%' THEN 8 END AS width,
  CASE WHEN l_linenumber = 1 THEN l_partkey WHEN l_linenumber = 2 THEN -l_partkey END::DECIMAL(20, 0) AS displacement,
  CASE WHEN l_linenumber IN (1, 2) THEN 'ip_data_slot' || CASE l_linenumber WHEN 1 THEN 32 ELSE 64 END WHEN l_linenumber = 3 THEN CASE WHEN l_partkey * 1000 <= 1048575 THEN 'imm_small' ELSE 'imm_address_like' END WHEN l_linenumber = 4 THEN 'imm_small' WHEN l_linenumber = 5 THEN 'stack128' WHEN l_linenumber = 6 THEN CASE WHEN l_partkey = 0 THEN 'imm_small' ELSE 'imm_unknown' END ELSE 'general_pointer8' END AS class,
  count(*) AS n FROM o GROUP BY ALL""")
def operand_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = tables.read(spark, sf_dir, "lineitem").select("l_partkey", "l_linenumber")
    p, n = F.col("l_partkey"), F.col("l_linenumber")
    hex_ = lambda c: F.lower(F.hex(c))
    text = (
        F.when(n == 1, F.concat(F.lit("dword ptr [rip + "), p, F.lit("]"))).when(n == 2, F.concat(F.lit("qword ptr [rip - 0x"), hex_(p), F.lit("]"))).when(n == 3, F.concat(F.lit("0x"), hex_(p * 1000)))
        .when(n == 4, F.concat(F.lit("-"), p)).when(n == 5, "xmmword ptr [rsp + 8]").when(n == 6, F.concat(F.lit("0"), p)).otherwise("byte ptr [rax]")
    )
    kind = F.when(n.isin(3, 4, 6), "immediate").otherwise("memory")
    rows = line.groupBy(text.alias("operand"), kind.alias("kind")).agg(F.count("*").alias("n"))
    t = F.col("operand")
    return rows.select("operand", S.parse_integer(t).alias("number"), S.memory_width(t).alias("width"), S.rip_displacement(t).alias("displacement"), S.normalize_operand(t, F.col("kind"), F.lit(None).cast("int"), F.lit("MOV")).alias("class"), "n")


@query("""SELECT n_nationkey AS id, sha256('{"name":"' || n_name || '","region":' || n_regionkey || '}') AS digest, 'FUN_' || printf('%08x', n_nationkey::BIGINT * 123456789 + 1048576) AS member, n_nationkey::BIGINT * 123456789 AS address FROM nation""")
def canonical_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tables.read(spark, sf_dir, "nation")
    address = F.col("n_nationkey").cast("long") * 123456789
    member = S.function_id(address)
    return n.select(F.col("n_nationkey").alias("id"), S.canonical_sha256(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))).alias("digest"), member.alias("member"), S.address_of_id(member).cast("long").alias("address"))


@query("SELECT event_type AS key, count(*) AS n FROM events GROUP BY event_type")
def event_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("key")).agg(F.count("*").alias("n"))


@query("""
WITH s AS (SELECT s_nationkey AS g, list(DISTINCT l_partkey) AS parts, s_suppkey FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL),
h AS (SELECT g, min(s_suppkey) AS hub FROM s GROUP BY g),
u AS (SELECT h.hub, s.s_suppkey AS other, s.parts AS b, k.parts AS a FROM h JOIN s ON s.g = h.g AND s.s_suppkey <> h.hub JOIN s k ON k.s_suppkey = h.hub)
SELECT hub, other, len(list_intersect(a, b))::INTEGER AS common, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) AS jaccard, round(least(len(a), len(b))::DOUBLE / greatest(len(a), len(b)), 6) AS ratio FROM u""")
def set_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard of the parts of each supplier and the first of its nation."""
    s, line = tables.read(spark, sf_dir, "supplier"), tables.read(spark, sf_dir, "lineitem")
    parts = line.join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_nationkey").alias("g"), F.col("s_suppkey")).agg(F.collect_set("l_partkey").alias("b"))
    hub = parts.groupBy("g").agg(F.min_by(F.struct(F.col("s_suppkey").alias("hub"), F.col("b").alias("a")), "s_suppkey").alias("h")).select("g", "h.hub", "h.a")
    rows = parts.join(hub, "g").where("s_suppkey <> hub")
    return rows.select("hub", F.col("s_suppkey").alias("other"), F.size(F.array_intersect("a", "b")).alias("common"), F.round(S.set_jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"), F.round(S.ratio(F.size("a"), F.size("b")), 6).alias("ratio"))


@query("""
WITH n AS (SELECT page_id, 'x' || regexp_replace(regexp_extract(coalesce(url, ''), '://([^/.]+)', 1), '[^a-z0-9]', '_', 'g') AS h, page_id % 4 AS k FROM pages)
SELECT page_id, CASE k WHEN 0 THEN h || '::page::get' WHEN 1 THEN h || '::Page::get' WHEN 2 THEN '<' || h || '::Page as core::Clone>::get' ELSE 'web::impl_for=' || h || '::Page::get' END AS canonical_origin, CASE k WHEN 3 THEN 'web' ELSE h END AS owner FROM n""")
def name_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical origin and owner of names made from page addresses; tests hold the rules against more cases."""
    host = F.concat(F.lit("x"), F.regexp_replace(F.regexp_extract(F.coalesce("url", F.lit("")), "://([^/.]+)", 1), "[^a-z0-9]", "_"))
    k, end = F.col("page_id") % 4, F.lit("::h0123456789abcdef")
    name = (
        F.when(k == 0, F.concat(host, F.lit("::page::get"), end))
        .when(k == 1, F.concat(host, F.lit("::Page<u8, Vec<T>>::get::<u8>"), end))
        .when(k == 2, F.concat(F.lit("<"), host, F.lit("::Page<T> as core::Clone>::get::<u8>"), end))
        .otherwise(F.concat(F.lit("web::<impl core::Clone for "), host, F.lit("::Page<T>>::get")))
    )
    rows = tables.read(spark, sf_dir, "pages").select("page_id", name.alias("name"))
    return rows.select("page_id", names.canonical_origin(F.col("name")).alias("canonical_origin"), names.symbol_owner(F.col("name")).alias("owner"))


@query("SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.tumbling(tables.read(spark, sf_dir, "events"), "10 minutes")
    return out.withColumn("total", F.round("total", 4))


@query("""SELECT id, fault FROM (SELECT s_suppkey AS id, CASE WHEN s_nationkey < 3 THEN 'missing' END AS fault FROM supplier) WHERE fault IS NOT NULL""")
def partition_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members that a partition lacks against another."""
    strict = tables.read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("family_id"), F.col("s_suppkey").alias("id"))
    return validate.partition_faults(strict.where("family_id >= 3"), strict)
