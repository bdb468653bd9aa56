"""Token alignment, periodic runs and token files against brute force and the tokenizer libraries."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from chartline.llm import chunks, flat, queries, token_alignment, token_shards, word_runs

from .conftest import SF

A, B, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))
SCRAPS = [
    "hello", " ", "  ", "\n", "\n\n", "\t", " ", "　", " ", " word", "é", "ß", "жук", "日本", "한국", "😀", "'s", "'ll", "123", "<|endoftext|>",
    "<s>", "</s>", "<unk>", "▁", "\x00", "\r\n", "...", "é", "​", "﻿", "ﬁ", "\x85", "᠎", "‘", "”", "<0x41>", "\x1c", "İ", "Σ", "1.5", "a,b", ".",
]


def scraps(n, seed):
    draw = random.Random(seed)
    return ["".join(draw.choice(SCRAPS) for _ in range(draw.randint(1, 25))) for _ in range(n)]


# Runs of words


def plain_runs(words, least=24):
    n, found = len(words), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            length = i + p - start
            if length >= max(least, 3 * p):
                found.setdefault((start, length), p)
            i += 1
    return sorted(((s, n_, p) for (s, n_), p in found.items()), key=lambda r: (r[0], r[2]))


def split(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def altered(words, doc_id):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_difference_cover_meets_every_pair():
    steps = np.arange(word_runs.MODULUS)
    held = set(word_runs.COVER.tolist())
    for i in steps.tolist():
        for j in steps.tolist():
            ahead = int(word_runs._AHEAD[i, j])
            assert (i + ahead) % word_runs.MODULUS in held and (j + ahead) % word_runs.MODULUS in held


@pytest.mark.parametrize("seed", range(6))
def test_runs_as_by_brute_force(seed):
    draw = random.Random(seed)
    for _ in range(60):
        texts = []
        for _ in range(draw.randint(1, 12)):
            n, k = draw.choice([0, 1, 5, 23, 24, 30, 80, 200, 400]), draw.choice([1, 2, 3, 10, 50])
            words = [draw.randrange(k) for _ in range(n)]
            if draw.random() < 0.7 and n > 10:
                a = draw.randrange(n)
                p, end = draw.randint(1, max(1, (n - a) // 3)), draw.randint(a, n)
                for i in range(a + p, end):
                    words[i] = words[i - p]
            texts += [words] * draw.choice([1, 1, 2])
        of, *rest = word_runs.runs_of(np.array(sum(texts, []), np.int64), np.array([len(t) for t in texts]))
        got = defaultdict(list)
        for text, *run in zip(of.tolist(), *(x.tolist() for x in rest), strict=True):
            got[text].append(tuple(run))
        assert [got[k] for k in range(len(texts))] == [plain_runs(t) for t in texts]


def test_extensions_as_by_comparison():
    draw = np.random.default_rng(1)
    words = np.concatenate([draw.integers(0, 2, 300), np.tile(draw.integers(0, 5, 45), 9), [9]])
    left, right = np.triu_indices(len(words) - 1, 1)
    some = draw.choice(len(left), 4000, replace=False)
    left, right = left[some], right[some]
    got = word_runs.Extensions(words, np.zeros(len(words), np.int64)).ahead(left, right)
    for i, j, k in zip(left.tolist(), right.tolist(), got.tolist(), strict=True):
        assert (words[i : i + k] == words[j : j + k]).all() and (j + k == len(words) or words[i + k] != words[j + k])


def test_a_long_text_is_one_run():
    period = np.random.default_rng(0).integers(0, 5000, 30_000)
    words = np.concatenate([np.arange(5000, 45_000), np.tile(period, 5)])
    assert [x.tolist() for x in word_runs.runs_of(words, np.array([len(words)]))] == [[0], [40_000], [150_000], [30_000]]


def expected_runs(doc_id, text):
    words = altered(split(text), doc_id)
    runs = plain_runs(words)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    return {
        "doc_id": doc_id, "n_runs": len(runs), "start": best[0], "length": best[1], "period": best[2],
        "exponent_milli": best[1] * 1000 // best[2] if runs else None,
        "runs_sha256": hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest(),
        "collapsed_sha256": hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest(),
    }


def test_op12_as_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = [expected_runs(r.doc_id, r.text) for r in docs if len(split(r.text)) < 1500]
    assert sum(w["n_runs"] > 0 for w in want) > 5
    got = {r.doc_id: r.asDict() for r in word_runs.query(spark, SF).collect()}
    assert len(got) == len(docs)
    for w in want:
        assert got[w["doc_id"]] == w


def test_runs_of_awkward_rows(spark):
    periodic = "a b c " * 10
    rows = [(None, None, 1), (1, "", 2), (2, " \t\n", 3), (3, periodic, 4), (3, periodic, 4), (4, "x y " * 24, 5), (5, "w " * 23, 6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, repeats int")
    got = sorted(([r.doc_id, r.repeats.n_words, [tuple(x) for x in r.repeats.runs], r.repeats.collapsed] for r in word_runs.find_runs(docs).collect()), key=str)
    assert got == sorted([
        [None, 0, [], ""], [1, 0, [], ""], [2, 0, [], ""], [3, 30, [(0, 30, 3)], "a b c"], [3, 30, [(0, 30, 3)], "a b c"],
        [4, 24, [(0, 24, 1)], "x y"], [5, 23, [], " ".join("w" * 23)],
    ], key=str)
    assert word_runs.find_runs(docs.withColumn("row", F.lit(1)).limit(0)).collect() == []
    assert word_runs.find_runs(docs.withColumns({"row": F.lit(1), "found": F.lit(2)})).columns == ["doc_id", "text", "row", "found", "repeats"]


# Token alignment


@pytest.fixture(scope="module")
def model():
    return token_alignment.aligner(A, B)


def plain_alignment(model, text):
    """(ids of A, ids of B, groups, links) of a text with tokens, else None."""
    if not text:
        return None
    raw = (" " + text).encode()
    a, b = model.a.encode(" " + text, add_special_tokens=False).ids, model.b.encode(text)
    a_raw, b_raw = ([s.bytes[s.starts[k] : s.starts[k] + s.lengths[k]].tobytes() for k in ids] for s, ids in ((model.a_raw, a), (model.b_raw, b)))
    if b"".join(a_raw) != raw or b"".join(b_raw) != raw:
        return None
    a_end, b_end = np.cumsum([len(x) for x in a_raw]).tolist(), np.cumsum([len(x) for x in b_raw]).tolist()
    groups, i, j = [], 0, 0
    for end in sorted(set(a_end) & set(b_end)):
        x, y = a_end.index(end) + 1, b_end.index(end) + 1
        groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
        i, j = x, y
    owner_b = [l for l, x in enumerate(b_raw) for _ in x]
    links, at = [], 0
    for k, x in enumerate(a_raw):
        links += [(a[k], b[l]) for l in sorted(set(owner_b[at : at + len(x)]))]
        at += len(x)
    return a, b, groups, links


def expected_alignment(model, rows):
    found = {t: plain_alignment(model, t) for t in {t for _, t in rows}}
    counts = Counter()
    for _, t in rows:
        counts.update(found[t][3] if found[t] else ())
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for doc_id, t in rows:
        if not found[t]:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = found[t]
        out.append((
            doc_id, len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links),
            hashlib.sha256(";".join(groups).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def test_op11_as_by_brute_force(spark, model):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    columns = ("doc_id", *token_alignment.MEASURES, "groups_sha256")
    got = sorted((tuple(r) for r in queries.op11_cross_tokenizer_alignment(spark, SF).select(*columns).collect()), key=str)
    assert got == expected_alignment(model, rows)


@pytest.mark.parametrize("sent_pairs", [0, token_alignment.SENT_PAIRS])
def test_alignment_of_awkward_rows(spark, model, sent_pairs):
    texts = [None, "", " ", "a", "same text", "same text", "same text ", "no▁tokens here", "x" * 3000, "word " * 2000, *scraps(400, 3)]
    rows = [*((k, t) for k, t in enumerate(texts)), (3, "a"), (None, "a row without id")]
    docs = spark.createDataFrame([(k, t, 7) for k, t in rows], "doc_id bigint, text string, alignment int")
    found = token_alignment.align(docs, A, B, sent_pairs=sent_pairs)
    assert found.columns == ["doc_id", "text", "alignment"]
    got = sorted((tuple(r) for r in found.select("doc_id", *(f"alignment.{c}" for c in (*token_alignment.MEASURES, "groups_sha256"))).collect()), key=str)
    assert got == expected_alignment(model, rows)


def test_alignment_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, h1 int, h2 int")
    assert token_alignment.align(docs, A, B).collect() == []
    none = spark.createDataFrame([(1, None, 2)], "doc_id bigint, text string, h1 int")
    assert [r.alignment.n_links for r in token_alignment.align(none, A, B).collect()] == [0]


def test_blocks_of_a_long_text(model, monkeypatch):
    texts = ["one two three " * 40, "", *scraps(60, 5)]
    raw = [(" " + t).encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    whole = model.texts(data, offsets)
    monkeypatch.setattr(token_alignment, "BLOCK_BYTES", 16)
    parts = model.texts(data, offsets)
    assert (whole[0] == parts[0]).all() and whole[1:] == parts[1:]


def test_small_cache_gives_the_same(model, monkeypatch):
    monkeypatch.setattr(chunks, "MOST_CHUNKS", 5)
    texts = scraps(50, 9)
    raw = [(" " + t).encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    fresh = token_alignment.Aligner(A, B)
    assert fresh.texts(data, offsets)[1] == fresh.texts(data, offsets)[1] == model.texts(data, offsets)[1]


# Token files


def plain_store(rows):
    """doc_id, start, n_tokens, ids_crc32 by the library."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD)
    out, start = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def stored(store, keys):
    found = token_shards.read(store, keys).select("doc_id", "start", "n_tokens", F.crc32("ids"))
    return sorted((tuple(r) for r in found.collect()), key=lambda r: r[1])


def test_op13_as_by_the_library(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in queries.op13_token_id_output(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])
    assert got == plain_store(rows)


def test_store_of_awkward_rows(spark):
    texts = [None, "", " ", "One", "<|startoftext|>x<|endoftext|>", "x" * 3000, "word, " * 3000, *scraps(500, 4)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id bigint, text string, part int").repartition(5)
    store = token_shards.write(docs, WORD, file_ids=500, bucket_keys=50)
    assert len(store.files) > 8 and store.buckets > 8
    assert stored(store, docs) == plain_store(rows)
    # the raw files hold the ids and nothing else
    system, root = flat.opened(store.folder)
    size = sum(system.get_file_info(f"{root}/{name}.ids").size for name in store.files)
    assert size == store.width * int(store.ids_before[-1]) and store.width == 2
    some = spark.createDataFrame([(3,), (3,), (-5,), (10**12,), (None,), (40,)], "doc_id bigint")
    assert [r[0] for r in stored(store, some)] == [3, 40]


def test_repeated_and_missing_keys(spark):
    rows = [(7, "same"), (7, "same"), (7, "other"), (None, "no id"), (None, None), (1, "first")]
    store = token_shards.write(spark.createDataFrame(rows, "doc_id bigint, text string"), WORD)
    got = stored(store, spark.createDataFrame([(7,), (None,), (1,)], "doc_id bigint"))
    assert [r[0] for r in got] == [None, None, 1, 7, 7, 7]
    assert sorted((r[0] or -1, *r[2:]) for r in got) == sorted((r[0] or -1, *r[2:]) for r in plain_store(rows))
    assert [b[1] for b in got] == np.cumsum([0, *(b[2] for b in got[:-1])]).tolist()


def test_text_keys_and_nothing(spark):
    docs = spark.createDataFrame([(f"key {k}", f"text {k}") for k in range(50)], "name string, body string")
    store = token_shards.write(docs, WORD, key="name", text="body")
    assert token_shards.read(store, docs.limit(7), key="name").count() == 7
    nothing = token_shards.write(docs.limit(0), WORD, key="name", text="body")
    assert token_shards.read(nothing, docs, key="name").collect() == []


def test_hash_is_minimal_and_perfect():
    draw = np.random.default_rng(2)
    for n in (0, 1, 2, 63, 5000):
        h1, h2 = draw.integers(0, 1 << 63, (2, n), np.uint64)
        segment = token_shards.built(h1, h2, np.arange(n), np.full(n, 3))
        first, copies = token_shards.found(segment, h1, h2)
        assert first.tolist() == list(range(n)) and (copies == 3).all()
        absent = draw.integers(0, 1 << 63, (2, 20_000), np.uint64)
        assert (token_shards.found(segment, *absent)[1] == 0).all()
        assert len(segment) <= 200 + 25 * n
    with pytest.raises(ValueError):
        token_shards.built(np.ones(2, np.uint64), np.ones(2, np.uint64), np.arange(2), np.ones(2))
