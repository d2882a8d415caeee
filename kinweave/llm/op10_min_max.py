"""Operator 10: near-duplicate groups by min-max hashing.

Each of n permutations of the shingle hashes is evaluated once and gives two values, the least and the
greatest image of a set, so that n evaluations make 2 n independent-enough unbiased signs of Jaccard
similarity. Signs are banded; sets that share a band are candidates. Equal sets are one node from the
start. What follows is linear in nodes and bands but for the last step:

1. A bucket is the nodes of one band; its hub is the one that shares most buckets with others. Every
   node of a bucket is compared with the hub, on full sets, and linked or not. Copies of one text meet
   in one hub, whatever their number, and never as all pairs.
2. Links are contracted to components by alternating large and small stars.
3. Nodes around one hub that are still in different components are settled, on full sets. Where they are few
   they meet in blocks of bounded size, spread over the cluster, large components in blocks of their own, which don't
   meet. Where they are many they are first brought together by their rarest shingles: two sets as similar as that share
   one among the first few of either in any common order, and by rising frequency these are those that
   hardly any other text has. So pages that share a template and differ in the rest don't meet, however many
   share a bucket. A shingle that several components have among their first makes their nodes meet, a few as
   pairs across components, more in blocks. Every pair that shares a band is settled: no cap, no sample.

The bands are chosen for the threshold so that a pair at the threshold shares none with a probability
below 1e-8. Similarity is exact: 100 * intersection >= percent * union of sets of 64-bit shingle hashes.

Defined results: a text with fewer words than a shingle is one shingle; null texts and texts without
words are empty and linked with nothing; rows that share a doc_id share a component; rows without a
doc_id are kept, unlinked, with a null component; empty tables give no row; extra columns are ignored,
and drop_near_duplicates() returns them untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinweave.operators import graph

from . import ragged, shingles, store

#: Permutations; twice as many values.
PERMUTATIONS = 120
#: Largest chance that a pair at the threshold shares no band.
MISS = 1e-8
#: Nodes of a block, in expectation.
BLOCK = 128
#: The pile of the components that have few nodes in a group; less than any node.
MIXED = -(1 << 63)
#: Nodes around a hub that meet in blocks; more are first brought together by rare shingles.
FEW = 16 * BLOCK
#: Nodes with a shingle in common that meet as pairs; more meet in blocks.
PAIRS = 16
#: Cells of a dense block comparison.
DENSE = 8_000_000


def rows_of_band(percent: int, permutations: int = PERMUTATIONS) -> int:
    """The most rows a band may have."""
    p = percent / 100
    fit = [r for r in range(1, 17) if (1 - p**r) ** (2 * permutations // r) <= MISS and 2 * permutations % r == 0]
    if not fit:
        raise ValueError("too few permutations for this similarity")
    return max(fit)


def signatures(docs: DataFrame, size: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, cls (digest of the set, null if empty), bands array<long> of each row, in the shared folder."""
    rows = rows_of_band(percent)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in ragged.chunks(batch.column(1), table=ragged.LOWER):
                sets = shingles.sets(c, size)
                cls = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                bands = [shingles.band_keys(shingles.min_max(s, PERMUTATIONS), rows) if len(s) else [] for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[c.lo : c.hi], pa.array([len(s) for s in sets], pa.int64()), pa.array(cls, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "cls", "bands"],
                )

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return store.keep(texts.mapInArrow(sign, "doc_id long, n_shingles long, cls binary, bands array<long>"), "signatures")


def similar(a: int, b: int, common: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays without repetitions."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def verify(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (hub, node) whose full sets are similar enough. texts: node, text."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, None
        for batch in batches:
            hubs = batch.column(0).to_pylist()
            keep = []
            done = 0
            for c in ragged.chunks(batch.column(3), table=ragged.LOWER):
                for s in shingles.sets(c, size):
                    if hubs[done] != hub or (text := batch.column(2)[done]) != text_before:
                        hub, text_before = hubs[done], batch.column(2)[done]
                        own = shingles.sets(next(ragged.chunks(batch.column(2)[done : done + 1], table=ragged.LOWER)), size)[0]
                    keep.append(similar(len(own), len(s), _common(own, s), percent))
                    done += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    left = texts.select(F.col("node").alias("hub"), F.col("text").alias("hub_text"))
    joined = pairs.join(texts, "node").join(left, "hub").select("hub", "node", "hub_text", "text")
    return joined.mapInArrow(check, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node that is reachable) of the nodes of edges (u, v), other than the least ones."""
    return graph.stars(edges).select(F.col("u").alias("node"), F.col("v").alias("component"))


def rare_groups(nodes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """hub (shingles of the same nodes), node, component, n_shingles, at, n: nodes (node, component) by those of their rarest shingles that several components have.

    Shingles are counted over all the nodes. In the order of rising frequency those that stand in one set alone come
    first, so that only their number is needed; at is a shingle's place in that order.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in ragged.chunks(batch.column(3), table=ragged.LOWER):
                sets = shingles.sets(c, size)
                long = [len(s) for s in sets]
                row = pa.array(np.repeat(np.arange(c.lo, c.hi), long))
                own = [batch.column(k).take(row) for k in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), *own, pa.array(np.repeat(long, long), pa.int64())], names=["hub", "node", "component", "text_id", "n_shingles"])

    held = nodes.join(texts, "node").select("node", "component", F.xxhash64("text").alias("text_id"), "text")
    every = store.keep(held.mapInArrow(spread, "hub long, node long, component long, text_id long, n_shingles long"), "all-shingles")
    often = every.groupBy("hub").agg(F.count("*").alias("often")).where("often > 1")
    again = every.join(often, "hub")
    mine = Window.partitionBy("node", "text_id")
    alone = F.col("n_shingles") - F.count("*").over(mine)
    last = F.col("n_shingles") - F.ceil(F.col("n_shingles") * percent / 100).cast("long") + 1
    again = again.withColumn("at", alone + F.row_number().over(mine.orderBy("often", "hub"))).where(F.col("at") <= last).drop("often", "text_id")
    again = store.keep(again, "rare-shingles")
    several = again.groupBy("hub").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who")).where("lo <> hi")
    # shingles of the same nodes are one group, however many they share
    met = again.join(several.select("hub", "n", "who"), "hub").groupBy("n", "who", "node", "component", "n_shingles").agg(F.min("at").alias("at"))
    return store.keep(met.select(F.xxhash64("n", "who").alias("hub"), "node", "component", "n_shingles", "at", "n"), "rare-groups")


def settle_rare(nodes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (u, v) that join the components of nodes (node, component): of any two that are similar enough, or of others that join the same."""
    groups = rare_groups(nodes, texts, size, percent)
    few = groups.where(F.col("n") <= PAIRS)
    b = few.select("hub", *(F.col(c).alias(f"{c}_b") for c in ("node", "component", "n_shingles", "at")))
    met = few.join(b, "hub").where((F.col("node") < F.col("node_b")) & (F.col("component") != F.col("component_b")))
    # before the first that they share nothing is shared, so what is left bounds the intersection
    first = met.groupBy("node", "node_b", "n_shingles", "n_shingles_b").agg(F.min("at").alias("at"), F.min("at_b").alias("at_b"))
    most = F.least(F.col("n_shingles") - F.col("at"), F.col("n_shingles_b") - F.col("at_b")) + 1
    pairs = first.where(100 * most >= percent * (F.col("n_shingles") + F.col("n_shingles_b") - most))
    pairs = store.keep(pairs.select(F.col("node").alias("hub"), F.col("node_b").alias("node")).distinct(), "rare-pairs")
    many = groups.where(F.col("n") > PAIRS).select("hub", "node", "component").distinct()
    return verify(pairs, texts, size, percent).unionByName(settle_blocks(many, texts, size, percent))


def settle(groups: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (u, v) that join the components among the nodes of each group (hub, node, component): small groups by blocks, large ones by rare shingles."""
    # what the largest component doesn't hold, since its nodes never meet each other
    sizes = groups.groupBy("hub", "component").agg(F.count("*").alias("n")).groupBy("hub").agg((F.sum("n") - F.max("n")).alias("n"))
    sized = groups.join(sizes, "hub")
    large = store.keep(sized.where(F.col("n") > FEW).select("node", "component").distinct(), "unsettled")
    return settle_blocks(sized.where(F.col("n") <= FEW).select("hub", "node", "component"), texts, size, percent).unionByName(settle_rare(large, texts, size, percent))


def settle_blocks(groups: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (u, v) between different components among the nodes of each group. groups: hub, node, component.

    A component with many nodes in a group is a pile of its own, the others share a pile. Piles fall into
    blocks of bounded size, and two blocks are a cell, which holds the two blocks' texts and no more.
    Nodes of one large component never meet, so a group in which thousands of linked copies stand beside a
    few other texts makes as many cells as the copies have blocks, not their square.
    """
    parts = groups.groupBy("hub", "component").agg(F.count("*").alias("n"))
    pile = F.when(F.col("n") >= BLOCK // 2, F.col("component"))
    parts = parts.select("hub", "component", "n", F.coalesce(pile, F.lit(MIXED)).alias("pile"))
    piles = store.keep(parts.groupBy("hub", "pile").agg(F.greatest(F.ceil(F.sum("n") / BLOCK), F.lit(1)).cast("int").alias("n")), "piles")
    placed = groups.join(parts.select("hub", "component", "pile"), ["hub", "component"]).join(piles, ["hub", "pile"])
    placed = placed.select("hub", "pile", F.pmod(F.xxhash64("node"), F.col("n")).cast("int").alias("block"), "node", "component")
    a = piles.select("hub", F.col("pile").alias("a_pile"), F.col("n").alias("a_n"))
    b = piles.select("hub", F.col("pile").alias("b_pile"), F.col("n").alias("b_n"))
    meet = a.join(b, "hub").where((F.col("a_pile") < F.col("b_pile")) | ((F.col("a_pile") == F.col("b_pile")) & (F.col("a_pile") == MIXED)))
    meet = meet.withColumn("a", F.explode(F.sequence(F.lit(0), F.col("a_n") - 1)))
    least = F.when(F.col("a_pile") == F.col("b_pile"), F.col("a")).otherwise(0)
    cells = meet.withColumn("b", F.explode(F.sequence(least, F.col("b_n") - 1))).select("hub", "a_pile", "a", "b_pile", "b")
    cell = ["hub", "a_pile", "a", "b_pile", "b"]
    left = cells.join(placed.withColumnsRenamed({"pile": "a_pile", "block": "a"}), ["hub", "a_pile", "a"]).select(*cell, F.lit(True).alias("first"), "node", "component")
    other = cells.where("a_pile <> b_pile OR a <> b").join(placed.withColumnsRenamed({"pile": "b_pile", "block": "b"}), ["hub", "b_pile", "b"])
    rows = left.union(other.select(*cell, F.lit(False), "node", "component")).join(texts, "node").select(*cell, "first", "node", "component", "text")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, component, first = (table.column(k).to_numpy() for k in ("node", "component", "first"))
        out = []
        if len(node) > 1 and (component != component[0]).any():
            sets = [s for c in ragged.chunks(table.column("text"), table=ragged.LOWER) for s in shingles.sets(c, size)]
            n = np.array([len(s) for s in sets])
            rows_a = np.flatnonzero(first)
            rows_b = rows_a if first.all() else np.flatnonzero(~first)
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while root.get(x, x) != x:
                    x = root[x]
                return x

            width = int(n.max(initial=1))
            step = max(1, min(len(node), DENSE // max(1, int(n.sum())), DENSE // width))
            for lo in range(0, len(rows_a), step):
                for hi in range(0, len(rows_b), step):
                    some, more = rows_a[lo : lo + step], rows_b[hi : hi + step]
                    common = _dense([sets[i] for i in some], [sets[i] for i in more])
                    good = 100 * common >= percent * (n[some][:, None] + n[more][None, :] - common)
                    good &= component[some][:, None] != component[more][None, :]
                    for i, j in zip(*np.nonzero(good), strict=True):
                        x, y = find(int(component[some[i]])), find(int(component[more[j]]))
                        if x != y:
                            root[max(x, y)] = min(x, y)
                            out.append((int(node[some[i]]), int(node[more[j]])))
        return pa.table({"u": pa.array([o[0] for o in out], pa.int64()), "v": pa.array([o[1] for o in out], pa.int64())})

    return rows.groupBy(*cell).applyInArrow(compare, "u long, v long")


def _dense(some: list[np.ndarray], more: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by a product of incidence matrices over what both lists hold."""
    both = np.intersect1d(np.unique(np.concatenate(some)), np.unique(np.concatenate(more)), assume_unique=True)

    def incidence(sets: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(sets), len(both)), np.float32)
        for i, s in enumerate(sets):
            at = np.searchsorted(both, s)
            at[at == len(both)] = 0
            out[i, at[both[at] == s]] = 1
        return out

    if not len(both):
        return np.zeros((len(some), len(more)), np.int64)
    return np.rint(incidence(some) @ incidence(more).T).astype(np.int64)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row."""
    signed = signatures(docs, size, percent, id_col, text_col)
    whole = signed.where("cls IS NOT NULL AND doc_id IS NOT NULL")
    nodes = store.keep(whole.groupBy("cls").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")), "nodes")
    banded = nodes.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = store.keep(banded.join(shared, "band"), "members")
    weight = members.groupBy("node").agg(F.sum("n").alias("weight"))
    hubs = members.join(weight, "node").groupBy("band").agg(F.max(F.struct("weight", "node")).getField("node").alias("hub"))
    stars = store.keep(members.join(hubs, "band").where("hub <> node").select("hub", "node").distinct(), "pairs")
    wanted = stars.select("node").union(stars.select(F.col("hub").alias("node"))).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    # by a merge join at every size: what must be read of the texts doesn't depend on whether the nodes wanted fit in a broadcast
    texts = store.keep(texts.join(wanted.hint("merge"), "node").dropDuplicates(["node", "text"]), "texts")
    linked = store.keep(verify(stars, texts, size, percent), "links")
    # rows that share a doc_id
    own = whole.select("doc_id", "cls").join(nodes.select("cls", "node"), "cls")
    same = own.groupBy("doc_id").agg(F.min("node").alias("u"), F.max("node").alias("v")).where("u <> v")
    same = same.select("u", "v").union(own.where("doc_id <> node").join(same.select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("u"), F.col("node").alias("v")))
    links = store.keep(linked.union(same), "links")
    found = components(links)

    def named(df: DataFrame, node: str, component: str) -> DataFrame:
        labels = found.select(F.col("node").alias(node), F.col("component").alias(component))
        return df.join(labels, node, "left").withColumn(component, F.coalesce(component, node))

    labelled = store.keep(named(stars, "node", "component"), "labelled")
    open_ = labelled.groupBy("hub").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("hub")
    groups = store.keep(labelled.join(open_, "hub", "left_semi").select("hub", "node", "component"), "open-groups")
    late = store.keep(settle(groups, texts, size, percent), "late-links")
    if not late.isEmpty():
        found = components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).union(late))
    class_of = named(nodes.select("cls", "node"), "node", "component_id").select("cls", "component_id")
    out = signed.select("doc_id", "n_shingles", "cls").join(class_of, "cls", "left")
    component = F.coalesce("component_id", "doc_id")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group: the rows of docs whose doc_id is the least of their component, columns as they are."""
    gone = near_duplicates(docs, size, percent, id_col, text_col).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["_gone"], "left_anti")


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, columns as they are: also of rows that share a doc_id, and of copies without one.

    Rows without a doc_id get stand-ins above all others, so that a row with a doc_id stays before they do. Of rows
    that share a doc_id the one of the least text stays.
    """
    doc_id = F.col(id_col).cast("long")
    top = docs.agg(F.coalesce(F.max(doc_id), F.lit(-1)).alias("top")).collect()[0]["top"]
    # written first: a stand-in must stay with its row
    nameless = store.keep(docs.where(doc_id.isNull()).withColumn("_id", F.lit(top + 1) + F.monotonically_increasing_id()), "nameless")
    named = docs.where(doc_id.isNotNull()).withColumn("_id", doc_id)
    again = store.keep(named.groupBy("_id").agg(F.count("*").alias("n")).where("n > 1").select("_id"), "repeated-ids")
    one = named.join(again, "_id", "left_semi").groupBy("_id").agg(F.min_by(F.struct(*docs.columns), F.struct(text_col)).alias("row")).select("row.*", "_id")
    rows = named.join(again, "_id", "left_anti").select(*docs.columns, "_id").unionByName(one).unionByName(nameless)
    found = near_duplicates(named.unionByName(nameless), size, percent, "_id", text_col)
    gone = found.where("NOT kept").select(F.col("doc_id").alias("_id")).distinct()
    return rows.join(gone, "_id", "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(store.documents(spark, sf_dir), size=3, percent=85)


#: DuckDB SQL for the rows of query(), where doc_id is unique: all pairs that share a shingle, then reachability.
ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1)) AS i FROM t)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
), reach AS (SELECT doc_id, doc_id AS root FROM t UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.doc_id)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, t.doc_id = component_id AS kept
FROM t LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""
