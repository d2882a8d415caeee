"""Operator 6 [native]: mixing sources to target weights by hierarchical budgets.

Only DataFrame functions run here. A tree of domains, languages and sources carries weights. A budget of
tokens runs down it level by level: siblings share their parent's budget by weight, a sibling that cannot
take its share (it has max_epochs times its tokens and no more) leaves the rest to its siblings, and only
what a whole family cannot take reaches the parent's siblings, since a node's capacity is that of its
leaves. Each level is settled in closed form by a window over siblings in the order of capacity per
weight, in whole numbers.

A leaf's budget is read from seeded epochs: each epoch is all of the leaf's documents in an order of its
own, md5(seed:epoch:doc_id), and the budget takes whole epochs and then the longest prefix of the next
that fits. The prefix is found without sorting a leaf in one place: tokens are summed by the first
hexadecimal digits of the order key, the bucket in which the budget ends is found from these sums, and
only that bucket's rows are put in order.

Defined results: tokens are words, [^\\x20\\x09-\\x0D]+; null texts have none; null languages or sources
are nodes named 'unknown', sources of no listed domain belong to 'other'; rows without a doc_id share one
order key; rows with equal doc_id are taken together or not at all; nodes without a weight have weight 1;
an empty table gives no row; extra columns come through mix_documents() as they are.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import store

LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class Mix:
    """Target weights (whole numbers) of a tree, epochs at most, seed, and the budget in tokens (default: as many as there are)."""

    domains: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"web": tuple(f"src{i}" for i in range(10)), "books": tuple(f"src{i}" for i in range(10, 15)), "forum": tuple(f"src{i}" for i in range(15, 20))}
    )
    domain_weights: dict[str, int] = field(default_factory=lambda: {"web": 6, "books": 3, "forum": 2})
    lang_weights: dict[str, int] = field(default_factory=lambda: {"en": 6, "de": 2, "fr": 2, "es": 1})
    source_weights: dict[str, int] = field(default_factory=lambda: {"src0": 8})
    max_epochs: int = 4
    seed: int = 17
    budget: int | None = None
    #: Hexadecimal digits of the order key that make a bucket.
    digits: int = 3


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def leaf_columns(mix: Mix) -> dict[str, Column]:
    source = F.coalesce(F.col("source"), F.lit("unknown"))
    domain = F.lit("other")
    for name, sources in mix.domains.items():
        domain = F.when(source.isin(*sources), name).otherwise(domain)
    return {"domain": domain, "lang": F.coalesce(F.col("lang"), F.lit("unknown")), "source": source}


def _weight(weights: dict[str, int], key: str) -> Column:
    out = F.lit(1)
    for name, w in weights.items():
        out = F.when(F.col(key) == name, w).otherwise(out)
    return out.cast("long")


def share(nodes: DataFrame, family: list[str], key: str) -> DataFrame:
    """Adds own, each node's part of its family's ``budget`` by ``weight``, within ``capacity``.

    In the order of capacity per weight, a node is filled if its capacity is at most its part of what those
    before it have left; the others divide the rest.
    """
    by = Window.partitionBy(*family) if family else Window.partitionBy()
    order = by.orderBy(F.col("capacity").cast("double") / F.col("weight"), key)
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    out = nodes.withColumn("_left", F.col("budget") - F.coalesce(F.sum("capacity").over(upto), F.lit(0)))
    out = out.withColumn("_weight", F.sum("weight").over(by) - F.coalesce(F.sum("weight").over(upto), F.lit(0)))
    out = out.withColumn("_full", F.col("capacity").cast("decimal(38,0)") * F.col("_weight") <= F.col("_left").cast("decimal(38,0)") * F.col("weight"))
    # the nodes before the first that is not full; what is left for the others, and their weight
    out = out.withColumn("_full", F.min(F.col("_full").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    rest = F.min(F.when(~F.col("_full"), F.struct(-F.col("_weight"), F.col("_left").alias("left")))).over(by)
    out = out.withColumn("_rest", rest)
    part = F.expr("CAST(floor(CAST(_rest.left AS DECIMAL(38,0)) * weight / CAST(-_rest.col1 AS DECIMAL(20,0))) AS BIGINT)")
    return out.withColumn("own", F.when(F.col("_full"), F.col("capacity")).otherwise(part)).drop("_left", "_weight", "_full", "_rest")


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """Each leaf (domain, lang, source, tokens) with budget, full_epochs and rest, the tokens of the epoch after those."""
    leaves = leaves.withColumn("capacity", F.col("tokens") * mix.max_epochs)
    # a handful of domains, each summed before they meet
    nodes = leaves.groupBy("domain").agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("_tokens"))
    budget = F.lit(mix.budget).cast("long") if mix.budget is not None else F.sum("_tokens").over(Window.partitionBy())
    nodes = nodes.withColumn("budget", budget).drop("_tokens").withColumn("weight", _weight(mix.domain_weights, "domain"))
    nodes = share(nodes, [], "domain").select("domain", F.col("own").alias("budget"))
    nodes = leaves.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity")).join(nodes, "domain").withColumn("weight", _weight(mix.lang_weights, "lang"))
    nodes = share(nodes, ["domain"], "lang").select("domain", "lang", F.col("own").alias("budget"))
    nodes = leaves.join(nodes, ["domain", "lang"]).withColumn("weight", _weight(mix.source_weights, "source"))
    nodes = share(nodes, ["domain", "lang"], "source").withColumn("budget", F.col("own"))
    full = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(1))
    return nodes.select(*LEVELS, "tokens", "budget").withColumn("full_epochs", full).withColumn("rest", F.col("budget") - F.col("full_epochs") * F.col("tokens"))


def order_key(mix: Mix, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(mix.seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def cuts(docs: DataFrame, mix: Mix) -> DataFrame:
    """For each leaf: full_epochs, and cut, the last order key that the prefix of the next epoch takes ('' for none)."""
    slim = store.keep(docs.select("doc_id", *(c.alias(k) for k, c in leaf_columns(mix).items()), n_tokens(F.col("text")).alias("n_tokens")), "mix-rows")
    leaves = store.keep(slim.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "mix-leaves")
    plan = store.keep(budgets(leaves, mix), "mix-plan")
    # a row a leaf; Spark picks the join by its measured size
    keyed = slim.join(plan.where("rest > 0").select(*LEVELS, "full_epochs", "rest"), list(LEVELS))
    keyed = keyed.withColumn("key", order_key(mix, F.col("full_epochs"), F.col("doc_id"))).withColumn("bucket", F.substring("key", 1, mix.digits))
    sums = keyed.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
    upto = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("before", F.sum("n").over(upto) - F.col("n"))
    last = sums.where("before <= rest").groupBy(*LEVELS).agg(F.max(F.struct("bucket", "before")).alias("end"))
    last = store.keep(last.select(*LEVELS, F.col("end.bucket").alias("bucket"), "end.before"), "mix-ends")
    inside = keyed.join(last, [*LEVELS, "bucket"]).groupBy(*LEVELS, "key").agg(F.sum("n_tokens").alias("n"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    run = Window.partitionBy(*LEVELS).orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    found = inside.withColumn("upto", F.col("before") + F.sum("n").over(run)).where("upto <= rest").groupBy(*LEVELS).agg(F.max("key").alias("found"))
    # where not one row of the last bucket fits, everything before that bucket does
    found = last.join(found, list(LEVELS), "left").select(*LEVELS, F.coalesce("found", "bucket").alias("cut"))
    return store.keep(plan.join(found, list(LEVELS), "left").select(*LEVELS, "full_epochs", F.coalesce("cut", F.lit("")).alias("cut")), "mix-cuts")


def mix_documents(docs: DataFrame, mix: Mix | None = None, epoch_col: str | None = None) -> DataFrame:
    """The selected rows of docs (doc_id, lang, source, text and whatever else), once for each epoch that takes them."""
    mix = mix or Mix()
    mark = "_mix_"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark = f"_{mark}"
    names = {k: f"{mark}{k}" for k in LEVELS}
    full, cut, epoch, epochs = (f"{mark}{x}" for x in ("full", "cut", "epoch", "epochs"))
    where = cuts(docs, mix).select(*(F.col(k).alias(names[k]) for k in LEVELS), F.col("full_epochs").alias(full), F.col("cut").alias(cut))
    rows = docs.select("*", *(c.alias(names[k]) for k, c in leaf_columns(mix).items())).join(where, list(names.values()))
    more = (order_key(mix, F.col(full), F.col("doc_id")) <= F.col(cut)).cast("int")
    rows = rows.withColumn(epochs, (F.col(full) + more).cast("int")).where(F.col(epochs) > 0)
    rows = rows.withColumn(epoch, F.explode(F.sequence(F.lit(0), F.col(epochs) - 1)))
    own = [F.col(f"`{c}`") for c in docs.columns]
    return rows.select(*own, *([F.col(epoch).alias(epoch_col)] if epoch_col else []))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text")
    picked = mix_documents(docs, epoch_col="epoch")
    return picked.select("doc_id", "epoch", *(c.alias(k) for k, c in leaf_columns(Mix()).items()), n_tokens(F.col("text")).alias("n_tokens"))


def _case(column: str, weights: dict[str, int]) -> str:
    return f"CASE {column} {' '.join(f"WHEN '{k}' THEN {v}" for k, v in weights.items())} ELSE 1 END"


def _share_sql(source: str, family: str, key: str) -> str:
    by = f"PARTITION BY {family}" if family else ""
    return f"""
      SELECT * EXCLUDE (l, w, f, f0), CASE WHEN f THEN capacity ELSE CAST(floor_div(rest_l * weight, rest_w) AS BIGINT) END AS own FROM (
        SELECT *, max(CASE WHEN NOT f THEN w END) OVER ({by}) AS rest_w, arg_max(l, w) FILTER (NOT f) OVER ({by}) AS rest_l FROM (
          SELECT *, min(f0) OVER ({by} ORDER BY capacity::DOUBLE / weight, {key} ROWS UNBOUNDED PRECEDING) = 1 AS f FROM (
            SELECT *, CASE WHEN capacity::HUGEINT * w <= l * weight THEN 1 ELSE 0 END AS f0 FROM (
              SELECT *, (budget - coalesce(sum(capacity) OVER ({by} ORDER BY capacity::DOUBLE / weight, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::HUGEINT AS l,
                (sum(weight) OVER ({by}) - coalesce(sum(weight) OVER ({by} ORDER BY capacity::DOUBLE / weight, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::HUGEINT AS w
              FROM ({source})))))"""


def oracle(table: str = "documents", mix: Mix | None = None) -> str:
    """DuckDB SQL for the rows of query()."""
    m = mix or Mix()
    domain = "CASE " + " ".join(f"WHEN source IN ({', '.join(repr(s) for s in v)}) THEN '{k}'" for k, v in m.domains.items()) + " ELSE 'other' END"
    level1 = _share_sql(f"SELECT domain, sum(capacity)::BIGINT AS capacity, {'max(allof)' if m.budget is None else m.budget}::BIGINT AS budget, {_case('domain', m.domain_weights)} AS weight FROM (SELECT *, sum(tokens) OVER () AS allof FROM leaves) GROUP BY domain", "", "domain")
    level2 = _share_sql(f"SELECT domain, lang, capacity, budget, {_case('lang', m.lang_weights)} AS weight FROM (SELECT domain, lang, sum(capacity)::BIGINT AS capacity FROM leaves GROUP BY domain, lang) JOIN level1 USING (domain)", "domain", "lang")
    level3 = _share_sql(f"SELECT domain, lang, source, tokens, capacity, budget, {_case('source', m.source_weights)} AS weight FROM leaves JOIN level2 USING (domain, lang)", "domain, lang", "source")
    return f"""
WITH named AS (
  SELECT doc_id, {domain} AS domain, lang, source, n_tokens FROM (
    SELECT doc_id, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM {table})
), leaves AS (
  SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, (sum(n_tokens) * {m.max_epochs})::BIGINT AS capacity FROM named GROUP BY ALL
), level1 AS (SELECT domain, own AS budget FROM ({level1.replace('floor_div(rest_l * weight, rest_w)', '(rest_l * weight) // rest_w')})
), level2 AS (SELECT domain, lang, own AS budget FROM ({level2.replace('floor_div(rest_l * weight, rest_w)', '(rest_l * weight) // rest_w')})
), plan AS (
  SELECT domain, lang, source, tokens, own AS budget, CASE WHEN tokens > 0 THEN own // tokens ELSE 1 END AS full_epochs FROM ({level3.replace('floor_div(rest_l * weight, rest_w)', '(rest_l * weight) // rest_w')})
), keyed AS (
  SELECT *, md5('{m.seed}:' || full_epochs || ':' || coalesce(doc_id::VARCHAR, '')) AS key FROM named JOIN plan USING (domain, lang, source)
), counted AS (
  SELECT *, full_epochs + CASE WHEN budget > full_epochs * tokens AND sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key RANGE UNBOUNDED PRECEDING) <= budget - full_epochs * tokens THEN 1 ELSE 0 END AS epochs FROM keyed
)
SELECT doc_id, CAST(unnest(range(epochs)) AS INTEGER) AS epoch, domain, lang, source, n_tokens FROM counted
"""
