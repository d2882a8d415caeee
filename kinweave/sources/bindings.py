"""The driver's tables as the abstract tables that operators take.

body: a supplier, whose instructions are its line items in order of shipping; relation graph: customers and the
parts they order; transfers: events; families, slots and labels: groups of line items, orders and documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinweave.sources import tables

ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def instructions(spark: SparkSession, sf_dir: str, key: str = "l_suppkey", mark: str = "s") -> DataFrame:
    """id, offset, size, mnemonic_class, operands, control_flow, branch_target_offset, constants of suppliers' (or orders') line items."""
    rows = tables.read(spark, sf_dir, "lineitem")
    # dealt by id, so that what follows by id needs no second shuffle
    rows = rows.select(*ORDER, F.concat(F.lit(mark), key).alias("id"), F.concat("l_returnflag", "l_linestatus").alias("mnemonic_class"))
    rows = rows.withColumn("offset", F.row_number().over(Window.partitionBy("id").orderBy(*ORDER)) - 1)
    target = (F.col("l_partkey") % 97).cast("long")
    n = F.col("l_linenumber")
    flow = F.when(n == 1, "call").when(n == 3, "conditional_branch").when(n == 5, "local_jump").when(n == 6, "external_jump").when(n == 7, "return").otherwise("fallthrough")
    width = F.when(F.col("l_quantity") < 15, "reg8").when(F.col("l_quantity") < 35, "reg32").otherwise("reg64")
    second = F.when(F.col("l_discount") >= 0.05, "imm_small").otherwise("stack64")
    constant = F.round(F.col("l_tax") * 100).cast("decimal(20,0)")
    return rows.select(
        "id",
        "offset",
        F.lit(1).alias("size"),
        "mnemonic_class",
        F.array(width, second).alias("operands"),
        flow.alias("control_flow"),
        F.when(n.isin(3, 5), target).alias("branch_target_offset"),
        F.when(F.col("l_discount") >= 0.05, F.array(constant)).otherwise(F.array().cast("array<decimal(20,0)>")).alias("constants"),
        F.array().cast("array<struct<kind:string,value:string,status:string,resolver:string>>").alias("slots"),
    )


INSTRUCTIONS = """
ins AS (
  SELECT 's' || l_suppkey AS id,
    row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS pos,
    l_returnflag || l_linestatus AS m,
    CASE WHEN l_quantity < 15 THEN 'reg8' WHEN l_quantity < 35 THEN 'reg32' ELSE 'reg64' END AS op1,
    CASE WHEN l_discount >= 0.05 THEN 'imm_small' ELSE 'stack64' END AS op2,
    CASE l_linenumber WHEN 1 THEN 'call' WHEN 3 THEN 'conditional_branch' WHEN 5 THEN 'local_jump' WHEN 6 THEN 'external_jump' WHEN 7 THEN 'return' ELSE 'fallthrough' END AS flow,
    CASE WHEN l_linenumber IN (3, 5) THEN l_partkey % 97 END AS target,
    CASE WHEN l_discount >= 0.05 THEN CAST(round(l_tax * 100) AS BIGINT) END AS k
  FROM lineitem)
"""


def sizes(ins: DataFrame) -> DataFrame:
    return ins.groupBy("id").agg(F.count("*").alias("size"))


def relation(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, role, is_member, anchor; edges: src, dst, count) of customers, what they order, and their nations.

    Customers are members, parts are context with their brand as colour where they have one, else their size class.
    """
    customer, orders, line, part = (tables.read(spark, sf_dir, t) for t in ("customer", "orders", "lineitem", "part"))
    bought = orders.select("o_orderkey", "o_custkey").join(line.select("l_orderkey", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    edges = bought.groupBy(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("p"), (F.col("l_partkey") % 50)).alias("dst")).agg(F.count("*").alias("count"))
    nodes = customer.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.lit("member").alias("role"), F.lit(True).alias("is_member"), F.lit(None).cast("string").alias("anchor"))
    shelf = (F.col("p_partkey") % 50).alias("k")
    shelves = part.select(shelf).distinct().select(F.concat(F.lit("p"), "k").alias("id"), F.lit("context-only").alias("role"), F.lit(False).alias("is_member"), F.concat(F.lit("shelf"), (F.col("k") % 5)).alias("anchor"))
    return nodes.unionByName(shelves), edges


RELATION = """
edges AS (
  SELECT 'c' || o_custkey AS src, 'p' || (l_partkey % 50) AS dst, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL
), nodes AS (
  SELECT 'c' || c_custkey AS id, 'member' AS role, true AS is_member, NULL AS anchor FROM customer
  UNION ALL SELECT DISTINCT 'p' || (p_partkey % 50), 'context-only', false, 'shelf' || (p_partkey % 50 % 5) FROM part)
"""


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, callsite, seq, kind, operand_kind, target of events: a user's event is a site, its property the target."""
    e = tables.read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        F.col("user_id").alias("source"),
        (F.col("event_id") % 40).alias("callsite"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "click", "call").otherwise("tail-call").alias("kind"),
        F.when(F.col("event_id") % 3 == 0, "register").when(F.col("event_id") % 3 == 1, "memory").otherwise("immediate").alias("operand_kind"),
        F.when(F.col("event_id") % 5 == 0, F.lit(None)).otherwise(k).cast("long").alias("target"),
        F.lit(None).cast("string").alias("resolver"),
    )


TRANSFERS = """
tr AS (
  SELECT user_id AS source, event_id % 40 AS callsite, event_id AS seq, CASE WHEN event_type = 'click' THEN 'call' ELSE 'tail-call' END AS kind,
    CASE event_id % 3 WHEN 0 THEN 'register' WHEN 1 THEN 'memory' ELSE 'immediate' END AS operand_kind,
    CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS target
  FROM events)
"""


def filled_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """family, offset, index, kind, id, value, state: a part's suppliers with what their latest line item of it says."""
    line = tables.read(spark, sf_dir, "lineitem")
    last = line.groupBy((F.col("l_partkey") % 400).alias("family"), F.col("l_suppkey").alias("id")).agg(F.max(F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", "l_discount")).alias("x"))
    fields = F.array(*(F.struct(F.lit(i).alias("offset"), v.cast("string").alias("value")) for i, v in enumerate((F.col("x.l_returnflag"), F.col("x.l_linestatus"), F.when(F.col("x.l_quantity") >= 25, "high").otherwise("low"), F.when(F.col("x.l_discount") >= 0.01, F.when(F.col("x.l_discount") >= 0.05, "big").otherwise("small"))))))
    rows = last.select("family", "id", F.explode(fields).alias("f"))
    return rows.select("family", F.col("f.offset").alias("offset"), F.lit(0).alias("index"), F.lit("DATA_REFERENCE").alias("kind"), "id", F.col("f.value").alias("value"), F.when(F.col("f.value").isNull(), "missing").otherwise("resolved").alias("state"))


FILLED = """
last AS (
  SELECT l_partkey % 400 AS family, l_suppkey AS id, max({'a': l_shipdate, 'b': l_orderkey, 'c': l_linenumber, 'd': l_returnflag, 'e': l_linestatus, 'f': l_quantity, 'g': l_discount}) AS x FROM lineitem GROUP BY ALL
), filled AS (
  SELECT family, id, 0 AS off, x.d AS value FROM last UNION ALL SELECT family, id, 1, x.e FROM last
  UNION ALL SELECT family, id, 2, CASE WHEN x.f >= 25 THEN 'high' ELSE 'low' END FROM last
  UNION ALL SELECT family, id, 3, CASE WHEN x.g >= 0.01 THEN CASE WHEN x.g >= 0.05 THEN 'big' ELSE 'small' END END FROM last)
"""


def partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """group, id of documents by language and length class."""
    d = tables.read(spark, sf_dir, "documents")
    return d.select(F.concat_ws(":", "lang", F.floor(F.col("n_chars") / 1000)).alias("group"), F.col("doc_id").alias("id"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """origin, id of documents by source."""
    return tables.read(spark, sf_dir, "documents").select(F.col("source").alias("origin"), F.col("doc_id").alias("id"))
