"""Each operator against a brute-force version, on texts that are null, empty, long, repeated and awkward."""

import base64
import hashlib
import io
import random
import re
import wave
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from kinweave.llm import (
    op01_token_files,
    op02_repetition,
    op03_chat,
    op04_audio,
    op05_token_counts,
    op06_mixing,
    op07_bpe,
    op08_url_rules,
    op09_licenses,
    op10_min_max,
    store,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_tokens long, kept string, component_id string, bands int, node string, media string, key string, start string"


def prose(r, n):
    return " ".join("".join(r.choice("abcdeéè") for _ in range(r.randint(1, 7))) for _ in range(n))


def make_texts():
    r = random.Random(5)
    base = prose(r, 120)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    far = " ".join([*words[:60], prose(r, 60)])
    alphabet = "ab'stre ld \n\n\t.,!1²é　中ﬀ▁#*|<>THE "
    noise = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(60)]
    return [
        None, "", " ", "\n\n", "one", "two words", "Three small words", base, base, base.upper(), near, far, base + "\nend",
        "same line of text\n" * 12, prose(r, 30) + " " + "again and again " * 20, "a" * 3000, "ab" * 4000, " " * 500, "x " * 2000,
        "Released under the MIT License. " + prose(r, 30), "Licensed under CC BY-NC 4.0.", "under the mit license under the MIT license",
        "licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "foo<|endoftext|>bar <s> </s> <unk>", "don't we'll they've 'd'x", prose(r, 6000), *noise, *noise[:5],
    ]


TEXTS = make_texts()


def frame(spark, texts=None, ids=None):
    texts = TEXTS if texts is None else texts
    r = random.Random(9)
    rows = [(i if ids is None else ids[i], t, r.choice(["en", "en", "de", None]), f"src{r.randint(0, 3)}" if i % 7 else None, 1, "x", "y", 3, "n", "m", "k", "s") for i, t in enumerate(texts)]
    r.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).repartition(3).cache()


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_empty_tables_and_repeated_rows(spark):
    none, twice = frame(spark, []), frame(spark, ["the same words in a row", "the same words in a row", None], ids=[4, 4, None])
    json, tik, model = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))

    def files(df):
        uri = store.new_dir(spark, "t")
        return op01_token_files.read_token_files(spark, uri, op01_token_files.write_token_files(df, uri, json))

    runs = {
        op02_repetition.quality_report: 3,
        op02_repetition.filter_documents: 0,
        lambda d: op04_audio.digest_fingerprints(op04_audio.fingerprint_media(op04_audio.store_media(d))): 3,
        lambda d: op05_token_counts.count_tokens(d, model): 3,
        lambda d: op07_bpe.digest_documents(d, tik): 3,
        op09_licenses.scan_licenses: 3,
        op10_min_max.near_duplicates: 3,
        files: 3,
    }
    for f, n in runs.items():
        assert f(none).count() == 0
        assert f(twice).count() == n
    assert op06_mixing.mix_documents(none).count() == 0


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    uri = store.new_dir(spark, "test")
    manifest = op01_token_files.write_token_files(docs, uri, public_tokenizers.path("byte_bpe_50k.json"), shard_tokens=3000)
    got = by_id(op01_token_files.read_token_files(spark, uri, manifest))
    at = 0
    for i, t in enumerate(TEXTS):
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len({r["shard"] for r in got.values()}) > 3


def test_token_files_without_ids(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["one", "two words", "two words", None, "last of all", "of no id", "of no id", "", "fourth"]
    ids = [7, -3, -3, 7, 9, None, None, None, 8]
    for shard_tokens in (4, 1000):
        uri = store.new_dir(spark, "test")
        manifest = op01_token_files.write_token_files(frame(spark, texts, ids).repartition(3), uri, public_tokenizers.path("byte_bpe_50k.json"), shard_tokens=shard_tokens)
        rows = sorted(op01_token_files.read_token_files(spark, uri, manifest).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in rows] == sorted(i for i in ids if i is not None) + [None] * 3
        at, found = 0, []
        for r in rows:
            assert r.start == at
            at += r.n_tokens
            found.append((r.doc_id or 0, r.n_tokens, r.ids_crc32))
        want = [[*own.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
        assert sorted(found) == sorted((i or 0, len(w), zlib.crc32(np.array(w, "<u4").tobytes())) for i, w in zip(ids, want, strict=True))
        assert manifest.agg({"n_tokens": "sum"}).first()[0] == at


def test_elias_fano():
    r = np.random.default_rng(3)
    for n, top in ((0, 1), (1, 0), (1, 10**12), (257, 5), (1000, 10**9), (3000, 3000)):
        values = np.sort(r.integers(0, top + 1, n))
        ef, size = op01_token_files.EliasFano.read(memoryview(op01_token_files.EliasFano.of(values).to_bytes() + b"tail"))
        assert (np.concatenate([*ef.blocks(), values[:0]]) == values).all()
        assert all(len(b) == 257 and b[-1] == after[0] for b, after in zip(ef.blocks(1), list(ef.blocks())[1:], strict=False))
        assert [ef.select(i) for i in range(0, n, 41)] == values[::41].tolist()
        if n == 1000:
            assert size * 8 < n * (2.5 + np.log2(top / n)) + 400
    shard = op01_token_files.Shard.read(op01_token_files.Shard.pack(np.array([5, 9]), np.array([3, 0]), [np.array([1, 2], np.uint16), np.array([3], np.uint16)]))
    assert shard.document(0).tolist() == [1, 2, 3] and shard.document(1).tolist() == []


def test_repetition(docs):
    got = by_id(op02_repetition.quality_report(docs))
    for i, t in enumerate(TEXTS):
        w = WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        inside = {k + j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
        failed = len(w) < 20 or 100 * len(inside) > 30 * len(w)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(inside), failed)
        assert not (failed and r.kept)
    assert got[7].kept and not got[13].kept and not got[14].kept
    kept = {r.doc_id for r in op02_repetition.filter_documents(docs).collect()}
    assert kept == {i for i, r in got.items() if r.kept}
    assert op02_repetition.filter_documents(docs).columns == docs.columns


def test_chat(spark):
    r = random.Random(2)
    pieces = ["\\", "#", "###", "### User: ", "</turn>", "</turn>\n", "<", "/turn>", "a", " ", "\n", "é", "\\0", "\\a", "<|user|>", "<|end|>\n", "[INST]", "$1", "\\E"]
    rows = []
    for c in range(40):
        for t in range(r.randint(1, 5)):
            rows.append((c, t, r.choice(["user", "assistant", "system", "tool: #1", None]), r.choice([None, "", "".join(r.choice(pieces) for _ in range(8))]), "x"))
    rows += [(90, 0, "user", "q", ""), (90, 1, "assistant", "a", ""), (91, 0, "system", "s", ""), (91, 1, "user", "q", ""), (91, 2, "assistant", "a", ""), (91, 2, "assistant", "a", "")]
    whole = rows.copy()
    r.shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns string").repartition(3).cache()
    marked = op03_chat.Template(headers={"user": "<|user|>\n", "assistant": "<|assistant|>\n", "system": "<|system|>\n"}, general=("<|role:", "|>\n"), close="<|end|>\n")
    bracketed = op03_chat.Template(headers={"user": "[INST] ", "assistant": "[OUT] ", "system": "[SYS] ", "tool: #1": "[TOOL]"}, general=("[ROLE ", "] "), close=" [/]$", loss_roles=("assistant", "system"))
    for template in (None, marked, bracketed):
        check_chat(op03_chat.format_conversations(table, template), whole, template)
    assert op03_chat.digest_conversations(op03_chat.format_conversations(table.limit(0))).count() == 0


def test_templates_that_could_be_misread():
    for wrong in (
        {"close": ""}, {"close": "a"}, {"headers": {"user": "## ", "assistant": "## A"}}, {"headers": {"user": "## ", "assistant": "## "}}, {"headers": {"user": "###</t"}}, {"general": ("# ", "\\")},
    ):
        with pytest.raises(ValueError):
            op03_chat.Template(**wrong)


def check_chat(formatted, whole, template):
    got = {x.conv_id: x for x in op03_chat.digest_conversations(formatted, template).collect()}
    assert set(got) == {k for k, *_ in whole}
    bears = (template or op03_chat.Template()).loss_roles
    for c in got:
        turns = sorted((t, role or "", text or "") for k, t, role, text, _ in whole if k == c)
        loss = "".join(text for _, role, text in turns if role in bears)
        digest = hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in turns).encode()).hexdigest()
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())
        letters = "".join({"user": "u", "assistant": "a", "system": "s"}.get(role, "x") for _, role, _ in turns)
        assert got[c].valid == bool(re.fullmatch("s?(ua)+", letters))
    assert got[90].valid and not got[91].valid
    for x in formatted.collect():
        assert "".join(s.text for s in x.segments) == x.formatted and len(x.segments) == 3 * len(x.loss)
        assert x.formatted.count((template or op03_chat.Template()).close) == x.n_turns


def test_audio(docs):
    media = op04_audio.store_media(docs)
    arrays = op04_audio.fingerprint_media(media)
    got = by_id(op04_audio.digest_fingerprints(arrays))
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[7].feature == got[8].feature != got[11].feature
    stored = {r.doc_id: r.media for r in media.collect()}
    assert hashlib.sha256(stored[7]).hexdigest() == got[7].media_sha256 and len(stored[7]) == got[7].media_bytes
    with wave.open(io.BytesIO(stored[7])) as w:
        assert (w.getsampwidth(), w.getnchannels()) == (1, 1)
    tone = (128 + 100 * np.sin(2 * np.pi * np.arange(4096) * 32 / 256)).astype(np.uint8).tobytes()
    t, f = op04_audio.peaks(tone)
    assert Counter(f.tolist()).most_common(1)[0][0] == 32
    tail = (128 + 100 * np.sin(2 * np.pi * np.arange(64) * 32 / 256)).astype(np.uint8).tobytes()
    assert op04_audio.peaks(bytes([128]) * 256 + tail)[0].tolist().count(1) > 0  # the last samples are in a frame
    codes, prints = op04_audio.fingerprints(tone)
    assert (np.diff(codes) >= 0).all() and len(codes) == len(prints) > 0
    arrays = by_id(arrays)
    for i, r in got.items():
        times, found = plain_fingerprints(stored[i])
        assert (arrays[i].times, arrays[i].prints) == (times, found) and r.n_prints == len(found)
        assert r.feature == f"{len(found)}:" + hashlib.sha256((",".join(map(str, times)) + ";" + ",".join(map(str, found))).encode()).hexdigest()


def plain_fingerprints(media):
    """(times, prints) of a WAV file by a plain transform of each frame and loops over its bins."""
    with wave.open(io.BytesIO(media)) as w:
        x = (np.frombuffer(w.readframes(w.getnframes()), np.uint8).astype(np.float32) - 128) / 128
    x = np.concatenate((x, np.zeros((256 - len(x)) if len(x) < 256 else -len(x) % 128, np.float32)))
    spots = []
    for t in range((len(x) - 256) // 128 + 1):
        power = np.abs(np.fft.rfft(x[128 * t : 128 * t + 256] * np.hanning(256).astype(np.float32)))
        tops = [b for b in range(2, 128) if power[b] > power[b - 1] and power[b] >= power[b + 1]]
        spots += [(t, b) for b in sorted(tops, key=lambda b: -power[b])[:2]]
    pairs = sorted((t, f << 16 | g << 8 | (u - t)) for i, (t, f) in enumerate(spots) for u, g in spots[i + 1 : i + 4] if u - t <= 8)
    return [t for t, _ in pairs], [p for _, p in pairs]


def test_token_counts(docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    got = by_id(op05_token_counts.count_tokens(docs, path))
    for i, t in enumerate(TEXTS):
        n = len(own.encode(t or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 4096)


def ranks():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def test_bpe(docs):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(), special_tokens={})
    got = by_id(op07_bpe.digest_documents(docs, path))
    encoded = op07_bpe.encode_documents(docs, path)
    ids, texts = by_id(encoded), by_id(op07_bpe.decode_documents(encoded, path))
    for i, t in enumerate(TEXTS):
        want = own.encode_ordinary(t or "")
        assert ids[i].ids == want and texts[i].text == (t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_rank_queue_takes_ranks_in_order():
    queue = op07_bpe.RankQueue(70000)
    r = np.random.default_rng(1)
    given = r.integers(0, 70000, 500)
    queue.push(given, np.arange(500))
    queue.push(np.array([69999, 3, 3]), np.array([1, 5, 7]))
    out = []
    while (taken := queue.pop()) is not None:
        out += [taken[0]] * len(taken[1])
        assert (np.diff(taken[1]) >= 0).all()
    assert out == sorted([*given.tolist(), 3, 3, 69999])


def test_one_symbol_at_a_time_gives_the_same():
    vocabulary = op07_bpe.Vocabulary(ranks())
    parts = [t.encode() for t in TEXTS if t and len(t) < 300]
    whole = op07_bpe.encode_pretokens(vocabulary, parts)
    vocabulary.safe[:] = False
    assert all((a == b).all() for a, b in zip(whole, op07_bpe.encode_pretokens(vocabulary, parts), strict=True))


@pytest.mark.parametrize("budget", [None, 0, 500, 10**9])
def test_mixing(spark, docs, budget):
    import duckdb

    mix = op06_mixing.Mix(budget=budget, max_epochs=3, digits=1)
    picked = op06_mixing.mix_documents(docs, mix, epoch_col="epoch")
    assert picked.columns == [*docs.columns, "epoch"]
    got = sorted((r.doc_id, r.epoch) for r in picked.collect())
    documents = docs.select("doc_id", "text", "lang", "source").toPandas()  # noqa: F841
    want = sorted(duckdb.sql(op06_mixing.oracle(mix=mix)).df()[["doc_id", "epoch"]].itertuples(index=False, name=None))
    assert got == want
    sizes = {i: len(WORD.findall(t or "")) for i, t in enumerate(TEXTS)}
    total = sum(sizes[i] for i, _ in got)
    assert total <= (sum(sizes.values()) if budget is None else budget)
    if budget == 10**9:
        assert total == 3 * sum(sizes.values())


def test_shortages_stay_among_siblings(spark):
    leaves = spark.createDataFrame([("web", "en", "src0", 10), ("web", "en", "src1", 1000), ("web", "de", "src2", 1000), ("books", "en", "src10", 1000)], "domain string, lang string, source string, tokens long")
    mix = op06_mixing.Mix(domain_weights={"web": 1, "books": 1}, lang_weights={"en": 1, "de": 1}, source_weights={}, max_epochs=1, budget=400)
    got = {r.source: r.budget for r in op06_mixing.budgets(leaves, mix).collect()}
    assert got == {"src0": 10, "src1": 90, "src2": 100, "src10": 200}


def test_url_rules(spark):
    urls = [None, "abc", "http://NET/", "http://a.net?x/", "http://Example.NET/en/a#b", "http://x.org/fr/?q", "http://orgx/fr/", "ftp://ex.example.com/de/", "http://example.com/de", "x://y://z.net/a?b", "http://b.net#/"]
    want = ["", None, "net/", None, "example.net/en/", "org/fr/", None, "example.com/de/", None, None, None]
    rows = [(i, u, "x") for i, u in enumerate(urls)] + [(0, None, "x")]
    got = op08_url_rules.judge(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()
    assert len(got) == len(rows)
    for r in got:
        u = urls[r.page_id] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        assert (r.host, r.path, r.rule) == (host.lower(), path, want[r.page_id] or None)
        if r.rule:
            assert r.verdict == ("block" if r.rule in ("net/", "example.com/de/") else "allow")


def brute_rules(rows, support, confidence):
    """{(items, verdict): (confidence, support)} by trying all combinations of all tokens of rows (tokens, label); tokens of the same rows are one."""
    from itertools import combinations

    rows = [(set(t), label) for t, label in rows]
    least = max(1, -(-support * len(rows) // 1))
    where = {}
    for i, (t, _) in enumerate(rows):
        for token in t:
            where.setdefault(token, []).append(i)
    item = {}
    for token in sorted(where):
        item.setdefault(tuple(where[token]), token)
    item = {token: item[tuple(w)] for token, w in where.items() if len(w) >= least}
    rows = [({item[x] for x in t if x in item}, label) for t, label in rows]
    sets = {c for t, label in rows if label for k in range(1, len(t) + 1) for c in combinations(sorted(t), k)}
    out = {}
    for c in sets:
        hit = [label for t, label in rows if set(c) <= t]
        for label in ("block", "allow"):
            n = hit.count(label)
            if n >= support * len(rows) and n and n / len(hit) >= confidence:
                out[c, label] = (round(n / len(hit), 9), round(n / len(rows), 9))
    best = {(c, v): x for (c, v), x in out.items() if not any(set(d) < set(c) and w == v and y[0] >= x[0] for (d, w), y in out.items())}
    return best, item


def mined(spark, rows, *how):
    rules, known = op08_url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, label string").repartition(3), *how)
    got = {(tuple(x["items"]), x.verdict): (round(x.confidence, 9), round(x.support, 9)) for x in rules.collect()}
    return got, {x.token: x["item"] for x in known.collect()}, rules, known


def test_mined_rules_against_counting(spark):
    r = random.Random(4)
    rows = []
    for _ in range(400):
        tokens = sorted({r.choice("abcdef") for _ in range(r.randint(1, 4))})
        rows.append((tokens, "block" if "a" in tokens and "b" in tokens or r.random() < 0.05 else "allow"))
    rows += [(["a", "g"], None), (["g"], "odd")]
    got, items, rules, known = mined(spark, rows, 0.02, 0.9)
    assert (got, items) == brute_rules(rows, 0.02, 0.9) and (("a", "b"), "block") in got
    urls = spark.createDataFrame([(1, ["a", "b", "z"]), (2, ["a", "z"]), (3, ["z"]), (4, [])], "row long, tokens array<string>")
    assert {x.row: x.mined for x in op08_url_rules.match(urls, rules, known).collect()}.get(1) == "block"
    assert mined(spark, [])[:2] == ({}, {}) and mined(spark, [([], "block"), (None, "allow")])[:2] == ({}, {})


def test_mined_rules_of_long_urls(spark):
    r = random.Random(14)
    keys = [f"q:{i:02d}" for i in range(20)]
    rows = [(["d:hot", *keys], "block") for _ in range(100)]  # 21 frequent tokens, the domain's the most frequent
    rows += [(["d:hot"], "block") for _ in range(50)]
    four = ["w", "x", "y", "z"]
    rows += [(four, "block") for _ in range(20)] + [([t for t in four if t != u], "allow") for u in four for _ in range(20)]
    rows += [(sorted({r.choice("abcdef") for _ in range(r.randint(1, 6))}), r.choice(["block", "allow", None])) for _ in range(100)]
    r.shuffle(rows)
    got, items, rules, known = mined(spark, rows, 0.02, 0.9)
    assert (got, items) == brute_rules(rows, 0.02, 0.9)
    assert {items[k] for k in keys} == {keys[0]} and got[("d:hot",), "block"][1] == round(150 / len(rows), 9)
    assert (tuple(four), "block") in got
    urls = spark.createDataFrame([(1, [keys[13]]), (2, ["w", "x", "y"]), (3, four)], "row long, tokens array<string>")
    found = {x.row: x.mined for x in op08_url_rules.match(urls, rules, known).collect()}
    assert found[1] == found[3] == "block" and found.get(2) != "block"


def test_judge_against_brute_force(spark):
    r = random.Random(16)
    urls = []
    for i in range(300):
        bad = r.random() < 0.2
        host = r.choice(["win.casino-one", "free-bets", "m.cheap-pills"]) + ".example.com" if bad and r.random() < 0.97 else r.choice(["news", "m.shop", "blog.a"]) + r.choice([".example.com", ".site.org", ".b.example.net"])
        path = "/offer/" if bad else r.choice(["/en/", "/fr/", "/de/", "/"])
        urls.append(f"https://{host}{path}{r.randint(0, 99)}{r.choice(['', '.html', '?utm=1', '#top'])}")
    urls += urls[:20] + [None, "nothing", "http://lone.example.com/offer/7"]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, row string, tokens string").repartition(4)
    got = {x.page_id: x for x in op08_url_rules.judge(pages, support=0.02).collect()}
    assert len(got) == len(urls)

    def tokens(u):
        rest = (u or "").split("://", 1)[1] if "://" in (u or "") else ""
        host = re.match(r"[^/?#]*", rest)[0].lower()
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        names = host.split(".")
        out = {"d:" + ".".join(names[-2:]), "t:" + names[-1], *("s:" + x for x in names[:-2])} if host else set()
        out |= {"p:" + re.sub("[0-9]+", "0", x) for x in path.split("/") if x}
        out |= {"e:" + m[1] for m in [re.search(r"\.([A-Za-z0-9]{1,8})$", path)] if m}
        out |= {"q:" + x.split("=")[0] for m in [re.search(r"\?([^#]*)", rest)] if m for x in m[1].split("&")}
        return (out | ({"a:"} if "#" in rest else set()), host) if host else (set(), "")

    labelled = [(t, "block" if set(re.split(r"[.-]", host)) & set(op08_url_rules.WORDS) else "allow") for t, host in map(tokens, urls) if t]
    rules, items = brute_rules(labelled, 0.02, 0.9)
    blocked = set()
    for i, u in enumerate(urls):
        own = {items[t] for t in tokens(u)[0] if t in items}
        fits = [(conf, verdict == "block", sup) for (need, verdict), (conf, sup) in rules.items() if set(need) <= own]
        want = None if got[i].rule or not fits else "block" if max(fits)[1] else "allow"
        assert got[i].mined == want
        assert got[i].verdict == (want or "allow") if not got[i].rule else got[i].mined is None
        blocked |= {i} if want == "block" else set()
    # mined rules reach a host in which no listed word stands
    assert len(urls) - 1 in blocked and not op08_url_rules.judge(pages.limit(0)).count()


def test_licenses(docs):
    got = by_id(op09_licenses.scan_licenses(docs))
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, t in enumerate(TEXTS):
        w = pattern.findall((t or "").translate(LOWER))
        hits = [(k, label) for phrase, label in op09_licenses.BASE for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        r = got[i]
        places = [k for k, _ in hits]
        base = {label for _, label in hits}
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted(base)))
        assert base <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_templates_without_a_base_phrase(spark):
    text = "Copyright. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"
    texts = [text, "words before it " + text + " and words after", "permission to deal in software is not granted free of charge", *[f"plain words number {i}" for i in range(60)]]
    got = by_id(op09_licenses.scan_licenses(frame(spark, texts)))
    assert [got[i].labels for i in range(3)] == ["mit", "mit", ""] and got[0].score > 0.9 and got[10].score == 0


def brute_licenses(texts):
    """(labels without base phrases, share) of each text: every alignment of every template, in which two different words agree."""
    plain = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER)) for t in texts]
    seen = Counter(w for words in plain for w in set(words))
    out = []
    for words in plain:
        labels, best = set(), 0.0
        for label, notice, keys in op09_licenses.ALL:
            own = notice.split()
            idf = [np.log((len(texts) + 1) / (seen[w] + 1)) + 1 for w in own]
            held = any(f" {k} " in f" {' '.join(words)} " for k in keys)
            for s in range(1 - len(own), len(words)):
                agree = [p for p in range(max(0, -s), min(len(own), len(words) - s)) if words[s + p] == own[p]]
                share = sum(idf[p] for p in agree) / sum(idf)
                if len({own[p] for p in agree}) > 1 and (held or share < op09_licenses.SHARE):
                    best = max(best, share)
                    if share >= op09_licenses.SHARE:
                        labels.add(label)
        out.append((labels, best))
    return out


def check_licenses(spark, texts):
    got = by_id(op09_licenses.scan_licenses(frame(spark, texts).repartition(2)))
    for i, (labels, best) in enumerate(brute_licenses(texts)):
        assert set(filter(None, got[i].labels.split(","))) == labels | set(filter(None, got[i].base_labels.split(",")))
        assert got[i].n_base or abs(got[i].score - best) < 2e-6
    return got


def test_several_licenses_in_one_text(spark):
    notices = [t[1] for t in op09_licenses.TEMPLATES]
    r = random.Random(12)
    pairs = [f"{a} {prose(r, 3)} {b}" for a in notices for b in notices if a < b]
    texts = [" ".join(notices), "\n".join(reversed(notices)), "", None, *r.sample(pairs, 30)]
    texts += [prose(r, 5) for _ in range(4 * len(texts))]
    got = check_licenses(spark, texts)
    assert set(got[0].labels.split(",")) == {t[0] for t in op09_licenses.TEMPLATES}


def test_licenses_of_common_words(spark):
    mit = op09_licenses.TEMPLATES[1][1]
    r = random.Random(13)
    got = check_licenses(spark, [f"{prose(r, 4)} {mit if i % 3 == 0 else ''}" for i in range(60)])
    assert all((g.labels == "mit") == (i % 3 == 0) for i, g in got.items())
    for n in (1, 5, 19):
        assert check_licenses(spark, [mit] + ["plain"] * (n - 1))[0].labels == "mit"


def test_short_license_grants(spark, sf):
    lines = {
        "This work is licensed under the GNU General Public License, version 3.": "gpl-3", "Licensed under the GNU General Public License, version 2": "gpl-2",
        "licensed under the GNU Lesser General Public License version 2.1": "lgpl-2.1", "It is licensed under the LGPL v3.": "lgpl-3", "licensed under the GNU Affero General Public License v3": "agpl-3",
        "Licensed under the BSD 3-Clause License": "bsd", "licensed under the Mozilla Public License, v. 2.0": "mpl-2", "Licensed under CC BY-SA 4.0": "cc-by-sa",
        "licensed under Creative Commons Attribution-NoDerivatives 3.0": "cc-by-nd", "GNU General Public License without more": "",
        "# SPDX-License-Identifier: GPL-2.0-only": "gpl-2", "SPDX-License-Identifier: Apache-2.0": "apache-2", "// SPDX-License-Identifier: CC0-1.0": "cc0",
    }
    got = check_licenses(spark, list(lines))
    assert [got[i].labels for i in range(len(lines))] == list(lines.values())
    texts = [r.text for r in store.documents(spark, sf).collect()]
    texts = [t for i, t in enumerate(texts) if i % 8 == 0 and len(t or "") < 4000 or "licen" in (t or "").lower()]
    got = check_licenses(spark, texts)
    phrases = {"general public license, version 3": "gpl-3", "under the mit license": "mit", "apache license, version 2": "apache-2", "cc by-nc": "cc-by-nc"}
    for i, t in enumerate(texts):
        for phrase, label in phrases.items():
            assert phrase not in (t or "").lower() or label in got[i].labels.split(",")


def brute_components(texts, size, percent):
    sets = {}
    for i, t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, docs, size, percent):
    r = random.Random(6)
    words = prose(r, 200).split()
    # a cloud of copies, some similar to each other only through others, and a chain of versions
    cloud = []
    for _ in range(60):
        w = words.copy()
        for k in r.sample(range(200), r.randint(1, 9)):
            w[k] = prose(r, 1)
        cloud.append(" ".join(w))
    chain, w = [], prose(r, 150).split()
    for k in range(25):
        w[(7 * k) % 150] = prose(r, 1)
        chain.append(" ".join(w))
    texts = [*TEXTS, *cloud, *chain, chain[0]]
    want = brute_components(enumerate(texts), size, percent)
    got = by_id(op10_min_max.near_duplicates(frame(spark, texts).repartition(5), size, percent))
    assert {i: (g.n_shingles, g.component_id) for i, g in got.items()} == want
    assert all(g.kept == (i == want[i][1]) for i, g in got.items())
    assert len({want[i][1] for i in range(len(TEXTS), len(texts))}) < len(cloud)


def test_blocks_settle_what_stars_leave(spark, monkeypatch):
    monkeypatch.setattr(op10_min_max, "BLOCK", 4)
    r = random.Random(8)
    words = prose(r, 120).split()
    nodes = []
    for i in range(30):
        w = words.copy()
        for k in r.sample(range(120), r.randint(1, 4)):
            w[k] = prose(r, 1)
        nodes.append((i, " ".join(w)))
    texts = spark.createDataFrame(nodes, "node long, text string")
    monkeypatch.setattr(op10_min_max, "PAIRS", 3)
    both = op10_min_max.settle_rare(spark.createDataFrame([(i, i) for i, _ in nodes], "node long, component long"), texts, 3, 85)
    found = {x.node: x.component for x in op10_min_max.components(both).collect()}
    assert {i: found.get(i, i) for i, _ in nodes} == {i: c for i, (_, c) in brute_components(nodes, 3, 85).items()}
    groups = spark.createDataFrame([(-1, i, i) for i, _ in nodes], "hub long, node long, component long")
    links = op10_min_max.settle_blocks(groups, texts, 3, 85)
    found = {x.node: x.component for x in op10_min_max.components(links).collect()}
    want = brute_components(nodes, 3, 85)
    assert {i: found.get(i, i) for i, _ in nodes} == {i: c for i, (_, c) in want.items()}
    assert links.count() < 30 * 29 / 2
    # a large component beside small ones: it meets them, whole, and never itself
    some = {0: 0, **{i: 1 for i in range(1, 20)}}
    groups = spark.createDataFrame([(-1, i, some.get(i, i)) for i, _ in nodes], "hub long, node long, component long")
    late = [(x.u, x.v) for x in op10_min_max.settle_blocks(groups, texts, 3, 85).collect()]
    assert all(some.get(u, u) != some.get(v, v) for u, v in late)
    known = [(1, i) for i in range(2, 20)]
    found = {x.node: x.component for x in op10_min_max.components(spark.createDataFrame(known + late, "u long, v long")).collect()}
    root = {i: c for i, (_, c) in want.items()}
    joined = min(root[i] for i in range(1, 20))
    assert {i: found.get(i, i) for i, _ in nodes} == {i: joined if c in {root[k] for k in range(1, 20)} else c for i, c in root.items()}


def test_pages_of_one_template_dont_meet(spark, monkeypatch):
    monkeypatch.setattr(op10_min_max, "FEW", 100)
    r = random.Random(21)
    template = prose(r, 150)
    pages = {n: [(i, f"{template} {prose(r, 50)}") for i in range(n)] for n in (150, 600)}
    counts = {}
    for n, nodes in pages.items():
        twins = [(n + i, nodes[i][1] + " end") for i in range(10)]
        texts = spark.createDataFrame(nodes + twins, "node long, text string").repartition(4).cache()
        # all stand around one hub, each in a component of its own
        unsettled = texts.selectExpr("node", "node AS component")
        groups = op10_min_max.rare_groups(unsettled, texts, 5, 80)
        counts[n] = (groups.count(), groups.where(f"n > {op10_min_max.PAIRS}").count())
        links = {(x.u, x.v) for x in op10_min_max.settle(unsettled.selectExpr("-1L AS hub", "*"), texts, 5, 80).collect()}
        assert {tuple(sorted(x)) for x in links} == {(i, n + i) for i in range(10)}
    # what meets are the ten twins, however many pages there are
    assert counts[600][1] == counts[150][1] == 0 and counts[600][0] <= 2 * counts[150][0]


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)] + [(5, 5)]
    got = {x.node: x.component for x in op10_min_max.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {i: i for e in edges for i in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert {i: got.get(i, i) for i in root} == {i: find(i) for i in root}


def test_rows_that_share_a_doc_id_share_a_component(spark):
    r = random.Random(3)
    a, b, c = prose(r, 50), prose(r, 50), prose(r, 50)
    got = op10_min_max.near_duplicates(frame(spark, [a, b, b, c, None], ids=[5, 5, 9, 7, None]), 3, 85).collect()
    assert sorted((x.doc_id or -1, x.component_id, x.kept) for x in got) == [(-1, None, True), (5, 5, True), (5, 5, True), (7, 7, True), (9, 5, False)]
