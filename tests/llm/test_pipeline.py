"""The pipeline against a plain version of each stage, and the driver's registration."""

import base64
import random
import re
from collections import Counter

import duckdb
import public_tokenizers

import __spark_entry__
import corpus_pipeline
from kinweave.llm import op06_mixing

from .test_operators import WORD, brute_components, prose


def test_pipeline(spark, sf):
    import tiktoken

    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    kept = []
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        w = WORD.findall(t or "")
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        inside = {k + j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
        if len(w) >= 20 and 100 * len(inside) <= 30 * len(w):
            kept.append(i)
    after = corpus_pipeline.quality(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert after.columns == list(docs.columns)
    first = {r.doc_id for r in after.select("doc_id").collect()}
    assert first <= set(kept) and len(first) >= 0.97 * len(kept)
    texts = dict(zip(docs.doc_id, docs.text, strict=True))
    groups = brute_components([(i, texts[i]) for i in sorted(first)], 5, 80)
    second = {i for i in first if groups[i][1] == i}
    documents = docs[docs.doc_id.isin(second)]  # noqa: F841
    third = duckdb.sql(op06_mixing.oracle()).df()
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((i, len(own.encode_ordinary(texts[i] or ""))) for i in third.doc_id)
    assert sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, sf).collect()) == want


def test_one_row_of_each_group_stays(spark, sf):
    r = random.Random(15)
    a, b, c = (prose(r, 60) for _ in range(3))
    near = a + " end"
    rows = [(4, a), (4, a), (4, near), (9, near), (None, a), (None, b), (None, b), (None, b + " end"), (5, c), (5, c), (None, ""), (6, None), (7, prose(r, 60))]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string").repartition(4)
    got = corpus_pipeline.near_dedup(spark, docs, sf)
    assert got.columns == docs.columns
    got = [(x.doc_id, x.text) for x in got.collect()]
    assert sorted(i for i, _ in got if i is not None) == [4, 5, 6, 7]
    assert sorted(t[:60] for i, t in got if i is None) == ["", b[:60]] and dict(got)[4] == a
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), sf).count() == 0


def awkward(spark, rows):
    """Documents with nulls, columns that clash with what operators call theirs, and rows twice."""
    return spark.createDataFrame([(i, t, s, lang, "e", 1, None) for i, t, s, lang in rows], "doc_id long, text string, source string, lang string, _mix_epoch string, n_words int, component_id string")


def test_stages_take_awkward_rows(spark, sf):
    r = random.Random(31)
    long, plain = prose(r, 9000), [prose(r, 40) for _ in range(6)]
    rows = [(1, None, "src1", "en"), (2, "", None, None), (3, " \n ", "src1", "en"), (None, plain[0], "src1", None), (4, plain[1], None, "en"), (4, plain[1], None, "en"), (5, plain[2], "src1", "en"), (6, plain[2] + " end", "src1", "en"), (7, long, "src2", "de"), (8, "short", "src1", "en"), (None, None, None, None)]
    docs = awkward(spark, rows).repartition(3)
    good = corpus_pipeline.quality(spark, docs, sf)
    assert good.columns == docs.columns
    assert sorted((x.doc_id or 0, x.text) for x in good.collect()) == sorted((i or 0, t) for i, t, *_ in rows if t and len(t.split()) >= 20)
    apart = corpus_pipeline.near_dedup(spark, docs, sf)
    assert apart.columns == docs.columns
    assert sorted((x.doc_id or 0, x.text or "") for x in apart.collect()) == sorted([(0, ""), (0, plain[0]), (1, ""), (2, ""), (3, " \n "), (4, plain[1]), (5, plain[2]), (7, long), (8, "short")])
    mixed = corpus_pipeline.mix(spark, docs, sf)
    assert mixed.columns == docs.columns
    seen = Counter(x.doc_id for x in mixed.collect())
    assert set(seen) <= {i for i, *_ in rows} and seen[4] % 2 == 0
    coded = corpus_pipeline.encode(spark, docs, sf).collect()
    assert len(coded) == len(rows) and {x.doc_id: x.n_tokens for x in coded}[1] == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_registration():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names if re.match(r"op\d+_", n)) == list(range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
