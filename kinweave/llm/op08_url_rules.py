"""Operator 8: URL filters by listed rules and by mined association rules.

Listed rules (host, path) come first: a rule fits its host and all subdomains if the URL's path starts
with the rule's, and the longest fitting rule decides. What they leave open is judged by rules that are mined
from labels, and these come from elsewhere: from a table of labelled URLs, or, where there is none, from words
of a fixed list among the parts of host names, as public block lists hold them. The label goes to the URL; what is
mined are its other traits, host labels, domain, language and other path parts, endings and query keys, so
that rules reach URLs in whose hosts no such word stands.

FP-growth (Spark's) mines the combinations of tokens that come with a label; rules "combination, therefore label" are
kept by support and confidence, and pruned where a rule of some of their tokens says the same as surely. Tokens
that stand in the same URLs, each of them, are one item, so that the keys of one long query don't multiply.
Each kept rule is indexed under its rarest item; a URL looks up its items in that index and checks the rest of
each rule found. The surest rule decides, block before allow if they are equally sure, then the one of more
support; a URL that no rule matches is allowed.

Every token of every labelled URL is mined, and rules of any length. Tokens that are frequent and many in one URL,
but not always together, still multiply, as they do for every method that finds all frequent combinations.

Defined results: a null URL or one without '://' has an empty host and path, no tokens and is allowed;
repeated rows are judged alike; labels other than block and allow, and null ones, count as neither; with no
labelled URL nothing is mined; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

#: Listed rules: verdict, rule.
LISTED = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Share of the labelled URLs that hold a combination and its label; share of those with the combination that have the label.
SUPPORT = 0.005
CONFIDENCE = 0.9
VERDICTS = ("block", "allow")
RULES = "items array<string>, verdict string, confidence double, support double"
#: Words of host names that public block lists hold.
WORDS = ("ads", "adult", "bet", "bets", "casino", "malware", "phishing", "pills", "poker", "porn", "spam", "tracker", "viagra", "xxx")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Between the first '://' and '/', '?' or '#', A-Z lower-cased; from there to '?' or '#'."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def listed_rule(host: Column, path: Column, rules=LISTED) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, tail = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + tail))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """array<string> of distinct tokens: d: domain, t: its last label, s: a label before the domain, p: path part (numbers alike), e: ending, q: query key, a: anchor."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    n = F.size(labels)
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^([^=]*)", 1)), lambda x: x != "")
    one = lambda value, mark: F.when(value != "", F.array(F.concat(F.lit(mark), value))).otherwise(F.array().cast("array<string>"))
    tokens = F.concat(
        one(F.when(n > 1, F.concat_ws(".", F.slice(labels, F.greatest(n - 1, F.lit(1)), 2))).otherwise(""), "d:"),
        one(F.coalesce(F.try_element_at(labels, F.lit(-1)), F.lit("")), "t:"),
        F.transform(F.slice(labels, 1, F.greatest(n - 2, F.lit(0))), lambda x: F.concat(F.lit("s:"), x)),
        F.transform(parts, lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, r"[0-9]+", "0"))),
        one(ending, "e:"),
        F.transform(keys, lambda x: F.concat(F.lit("q:"), x)),
        F.when(F.contains(url, F.lit("#")), F.array(F.lit("a:"))).otherwise(F.array().cast("array<string>")),
    )
    return F.when(host != "", F.array_distinct(tokens)).otherwise(F.array().cast("array<string>"))


def suspicious(host: Column, words: tuple[str, ...] = WORDS) -> Column:
    """Whether a word of the list is a whole part of the host, between dots and hyphens."""
    return F.arrays_overlap(F.split(host, r"[.\-]"), F.array(*map(F.lit, words)))


def items(rows: DataFrame, least: int) -> DataFrame:
    """token, item: of the tokens that ``least`` rows (row, tokens) hold, those that the same rows hold have one item, the least of them.

    Their number is bounded by the support: at most the mean number of tokens in a row over it. Rows are told apart by
    two sums of 64-bit hashes.
    """
    sums = [F.sum(F.xxhash64("row", F.lit(seed)).cast("decimal(38,0)")).alias(f"s{seed}") for seed in (1, 2)]
    often = rows.select("row", F.explode(F.array_distinct("tokens")).alias("token")).where("token IS NOT NULL").groupBy("token").agg(F.count("*").alias("n"), *sums).where(F.col("n") >= least)
    first = often.groupBy("n", "s1", "s2").agg(F.min("token").alias("item"))
    return store.keep(often.join(first, ["n", "s1", "s2"]).select("token", "item"), "url-items")


def in_items(rows: DataFrame, known: DataFrame) -> DataFrame:
    """row, items array<string> of the rows (row, tokens) that hold any known token."""
    spread = rows.select("row", F.explode("tokens").alias("token"))
    return spread.join(F.broadcast(known), "token").groupBy("row").agg(F.collect_set("item").alias("items"))  # items() bounds known


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """(rules: items array<string>, verdict, confidence, support; known: token, item) of rows (tokens, label)."""
    spark = labelled.sparkSession
    rows = store.keep(labelled.select(F.monotonically_increasing_id().alias("row"), "tokens", "label"), "url-rows")
    n = rows.count()
    least = max(1, math.ceil(support * n))
    known = items(rows, least)
    held = in_items(rows, known).join(rows.select("row", "label"), "row")
    # a label is an item of its own kind: no token begins with a line break
    mark = F.when(F.col("label").isin(*VERDICTS), F.array(F.concat(F.lit("\n"), "label"))).otherwise(F.array().cast("array<string>"))
    sets = store.keep(held.select(F.concat("items", mark).alias("items")), "url-sets")
    m = sets.count()
    if not m:
        return spark.createDataFrame([], RULES), known
    found = FPGrowth(minSupport=min(1.0, least / m * (1 - 1e-12)), numPartitions=max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))).fit(sets).freqItemsets
    names = F.array_sort(F.filter("items", lambda x: ~F.startswith(x, F.lit("\n"))))
    found = store.keep(found.where(F.size(names) > 0).select(names.alias("items"), F.substring(F.try_element_at(F.filter("items", lambda x: F.startswith(x, F.lit("\n"))), F.lit(1)), 2, 99).alias("label"), F.col("freq")), "url-itemsets")
    every = found.where("label IS NULL").select("items", F.col("freq").alias("total"))
    sure = found.where("label IS NOT NULL").join(every, "items").select("items", F.col("label").alias("verdict"), (F.col("freq") / F.col("total")).alias("confidence"), (F.col("freq") / F.lit(n)).alias("support"))
    rules = store.keep(sure.where((F.col("confidence") >= confidence) & (F.col("support") * n >= least - 0.5)), "url-sure")
    return store.keep(pruned(rules), "url-rules"), known


def indexed(rules: DataFrame) -> DataFrame:
    """head, need, verdict, confidence, support: each rule under that of its items which the fewest rules have."""
    spread = rules.select(F.explode("items").alias("item"), "items", "verdict", "confidence", "support")
    uses = spread.groupBy("item").agg(F.count("*").alias("uses"))
    by = spread.join(uses, "item").groupBy(F.col("items").alias("need"), "verdict", "confidence", "support")
    return by.agg(F.min(F.struct("uses", "item")).getField("item").alias("head"))


def pruned(rules: DataFrame) -> DataFrame:
    """The rules beside which no rule of some of their items says the same as surely; found by the same index as URLs."""
    short = indexed(rules).select("head", "need", F.col("verdict").alias("_v"), F.col("confidence").alias("_c"))
    looked = rules.select("*", F.explode("items").alias("head")).join(short, "head").where((F.col("verdict") == F.col("_v")) & (F.col("_c") >= F.col("confidence")))
    idle = looked.where((F.size("need") < F.size("items")) & (F.size(F.array_except("need", "items")) == 0)).select("items", "verdict").distinct()
    return rules.join(idle, ["items", "verdict"], "left_anti")


def match(urls: DataFrame, rules: DataFrame, known: DataFrame) -> DataFrame:
    """row, mined: the verdict of the surest rule that each of urls (row, tokens) matches, for those that match one."""
    index = store.keep(indexed(rules), "url-index")
    held = in_items(urls, known)
    looked = held.select("row", "items", F.explode("items").alias("head")).join(index, "head").where(F.size(F.array_except("need", "items")) == 0)
    best = F.max(F.struct("confidence", (F.col("verdict") == "block").alias("block"), "support")).getField("block")
    return looked.groupBy("row").agg(best.alias("_block")).select("row", F.when(F.col("_block"), "block").otherwise("allow").alias("mined"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=LISTED, labelled: DataFrame | None = None, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict, mined of each row. labelled: (url, label block or allow).

    Without labelled URLs, those of pages whose hosts hold a listed word are examples of block and all others of allow.
    """
    parts = lambda df: df.withColumn("host", host_and_path(F.col("url"))[0]).withColumn("path", host_and_path(F.col("url"))[1]).withColumn("tokens", url_tokens(F.col("url"), F.col("host"), F.col("path")))
    rows = parts(pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url")))
    rule, verdict = listed_rule(F.col("host"), F.col("path"), rules)
    rows = store.keep(rows.withColumn("rule", rule).withColumn("listed", verdict).drop("url"), "url-pages")
    if labelled is None:
        examples = rows.where("size(tokens) > 0").select("tokens", F.when(suspicious(F.col("host")), "block").otherwise("allow").alias("label"))
    else:
        examples = parts(labelled.select(F.coalesce("url", F.lit("")).alias("url"), "label")).select("tokens", "label")
    found, known = mine(examples, support, confidence)
    mined = store.keep(match(rows.where("listed IS NULL AND size(tokens) > 0").select("row", "tokens"), found, known), "url-mined")
    # by a merge join at every size: a verdict a row isn't a small table
    out = rows.drop("tokens").join(mined.hint("merge"), "row", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("listed", "mined", F.lit("allow")).alias("verdict"), "mined")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
