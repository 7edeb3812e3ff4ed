"""Files of id planes, the audit of filters, and ranked search."""

import io
import random
import zlib
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from maskwright.llm import audit, idplanes, impact
from maskwright.llm.common import fresh_path
from maskwright.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"

# --- id planes --------------------------------------------------------------------------------------------------------


class Kept(io.BytesIO):
    def close(self):
        self.kept = self.getvalue()
        super().close()


class Sized(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def file_of(docs, bits, block):
    out = Kept()
    w = idplanes.Writer(out, bits, block)
    for doc_id, ids in docs:
        w.add(np.array([doc_id or 0]), np.array([doc_id is None]), np.array([len(ids)]), np.array(ids, "<u4"))
    w.close()
    return out.kept


@pytest.mark.parametrize("bits", [1, 8])
@pytest.mark.parametrize("block", [8, 64, 1 << 16])
def test_files_round_trip(bits, block):
    rng = random.Random(bits * block)
    docs = [(None, []), (-3, [0]), *((i, [rng.choice([0, 1, 255, 256, 50_000, 70_000, 2**32 - 1]) for _ in range(rng.randint(0, 40))]) for i in range(100)), (2**63 - 1, list(range(3000)))]
    r = idplanes.Reader(Sized(file_of(docs, bits, block)))
    assert [(d, x.tolist()) for d, _, x in r.documents()] == docs
    flat = [x for _, ids in docs for x in ids]
    assert r.total == len(flat) and r.ids(0, r.total).tolist() == flat
    for _ in range(50):
        a, b = sorted(rng.randrange(len(flat) + 1) for _ in range(2))
        assert r.ids(a, b).tolist() == flat[a:b]
    assert r.ids(5, 5).tolist() == [] and r.ids(r.total - 2, r.total + 9).tolist() == flat[-2:]


def test_small_ids_have_few_planes():
    assert len(idplanes.planes(np.array([0, 0]), 8)) == 0
    assert len(idplanes.planes(np.array([3, 255]), 8)) == 1
    assert len(idplanes.planes(np.array([3, 50_256]), 1)) == 16


def test_damaged_files_are_refused():
    raw = file_of([(1, list(range(500))), (2, [7] * 90)], 8, 64)
    for bad in (raw[:-1], raw[:20], b"X" + raw[1:], raw + b"x"):
        with pytest.raises(ValueError):
            idplanes.Reader(Sized(bad))
    at = idplanes.HEADER.size + 12
    flipped = raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1 :]
    with pytest.raises(Exception):
        list(idplanes.Reader(Sized(flipped)).documents())


def test_an_empty_file():
    r = idplanes.Reader(Sized(file_of([], 8, 64)))
    assert r.total == 0 and list(r.documents()) == [] and r.ids(0, 10).tolist() == []


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(idplanes.TOKENIZER)
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_stretches_encode_as_the_library_does(monkeypatch):
    rng = random.Random(4)
    bits = [" ", "  ", "\n", "\t", "a", "é", "\xa0", " ", "　", "1", "'s", ".", "…", "日", "😀", "\x1c", "\x85", "<|endoftext|>", "word", "Ä"]
    texts = [None, "", *("".join(rng.choice(bits) for _ in range(rng.randint(1, 20))) for _ in range(3000)), "x" * 5000, " \n" * 3000]
    for most in (2_000_000, 300):  # the latter: stretches are forgotten all the time
        monkeypatch.setattr(idplanes, "REMEMBERED", most)
        monkeypatch.setattr(idplanes, "TOGETHER", 4096)
        e = idplanes.Encoder(idplanes.TOKENIZER)
        assert e.by_stretch
        ids, n = e.encode(pa.array(texts))
        at = np.append(0, np.cumsum(n))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == library(texts)


def test_other_tokenizers_encode_whole_texts():
    e = idplanes.Encoder("/opt/tokenizers/word_bpe_49k.json")
    ids, n = e.encode(pa.array(["Two words", None, "x"]))
    assert not e.by_stretch and n[1] == 0 and ids[: n[0]].tolist() == e.tokenizer.encode("Two words", add_special_tokens=False).ids


def placed(docs):
    """Brute force: documents in order, each with the end id."""
    ordered = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    out, at = [], 0
    for (doc_id, _), ids in zip(ordered, library([t for _, t in ordered]), strict=True):
        raw = np.array([*ids, 2], "<u4").tobytes()
        out.append((doc_id, at, len(ids) + 1, zlib.crc32(raw)))
        at += len(ids) + 1
    return sorted(out, key=lambda r: r[1])


@pytest.mark.parametrize("rotate", [1 << 26, 50])
def test_tables_read_back(spark, rotate):
    rng = random.Random(5)
    docs = [(i * 7 % 211, " ".join(rng.choice(["tea", "Öl", "x1", "…"]) for _ in range(rng.randint(0, 30)))) for i in range(211)]
    docs += [(-(2**63), "least"), (2**63 - 1, None), (None, "no id"), (500, "long " * 20_000)]
    df = spark.createDataFrame([(*d, 1, "p") for d in docs], "doc_id long, text string, ids int, path string").repartition(7)
    folder = fresh_path(spark, "ids-test")
    manifest = idplanes.write_ids(df, folder, rotate=rotate, block=64)
    got = sorted(idplanes.read_ids(manifest, folder).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == placed(docs)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    assert (manifest.count() > 50) == (rotate == 50)


def test_rows_that_share_an_id(spark):
    df = spark.createDataFrame([(3, "a b")] * 40 + [(3, "c")] * 2 + [(1, "d")], "doc_id long, text string")
    folder = fresh_path(spark, "ids-test")
    got = sorted(idplanes.read_ids(idplanes.write_ids(df, folder), folder, ids=False).collect(), key=lambda r: r.start)
    assert len(got) == 43 and got[0].doc_id == 1
    assert all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:]))


def test_no_documents(spark):
    folder = fresh_path(spark, "ids-test")
    assert idplanes.read_ids(idplanes.write_ids(spark.createDataFrame([], "doc_id long, text string"), folder), folder).count() == 0


def test_op11_against_the_library(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(QUERIES["op11_idplanes"](spark, SF).collect(), key=lambda r: r.start)
    assert [tuple(r) for r in got] == placed(docs)


# --- audit ------------------------------------------------------------------------------------------------------------


def brute_masks(docs):
    first = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    out = []
    for doc_id, text, lang in docs:
        t = text or ""
        words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", t) if w]
        m = (len(words) < 100) + 2 * (100 * len(set(words)) < 80 * len(words)) + 4 * (100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t)) + 8 * any(c in "#$%&*|" for c in t)
        out.append((doc_id, lang or "", m + 16 * (doc_id is not None and doc_id > first[t])))
    return out


def brute_audit(masks, good, toxic):
    out = {}
    for part in {p for _, p, _ in masks}:
        mine = [(d, m) for d, p, m in masks if p == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                gone = [(d, m) for d, m in left if m & bit]
                fails = sum(1 for _, m in mine if m & bit)
                left = [(d, m) for d, m in left if not m & bit]
                removed_by[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), fails - len(gone), sum(m == bit for _, m in mine), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone), f]
        for key, row in out.items():
            if key[0] == part:
                row[-1] = removed_by[row[-1]]
    return out


def hostile_docs():
    rng = random.Random(6)
    long = "".join(rng.choice("ab cd\n") for _ in range(70_000))
    texts = [None, "", " ", "a", "A", "#", "é" * 300, "é" * 299 + "e", long, long[:-1] + "x", long[:256] + "y" + long[257:], long[:5000] + "y" + long[5001:], " ".join(f"w{i}" for i in range(200)), "same " * 150, "A B " * 60]
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(400)]
    return docs + [(5, "a", "en"), (5, "a", "en"), (7, "other", "en"), (7, "a", "de"), (None, "a", "en"), (None, "alone", None), (-9, "alone", "de")]


def test_masks_against_brute_force(spark):
    docs = hostile_docs()
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, lang string, mask int, part int").repartition(5)
    got = sorted(map(tuple, audit.masks(df).collect()), key=repr)
    assert got == sorted(brute_masks(docs), key=repr)


def test_equal_hashes_of_different_texts(spark, monkeypatch):
    """Classes that hold several texts are parted by the text."""
    docs = hostile_docs()
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    rows = df.filter("doc_id is not null").select(F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).withColumn("class", F.col("h") % 2)
    got = {(r.doc_id, r.h) for r in audit.later_copies(df, rows).collect()}
    late = {(d[0], d[1] or "") for d, m in zip(docs, brute_masks(docs), strict=True) if m[2] & 16}
    named = {(r.doc_id, r.text or ""): r.h for r in df.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).collect()}
    assert got == {(d, named[d, t]) for d, t in late}


def test_audit_against_brute_force(spark):
    docs = hostile_docs()
    labels = [(i, i % 3, i % 2) for i in range(0, 300, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (9999, 1, 1), (8, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    counts = audit.counted(audit.masks(df), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in audit.audited(counts).collect()}
    good, toxic = ({d for d, *x in labels if x[i] == 1 and d is not None} for i in (0, 1))
    assert got == brute_audit(brute_masks(docs), good, toxic)


def test_audit_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert audit.audited(audit.counted(audit.masks(none), spark.createDataFrame([], "doc_id long, quality int, toxic int"))).count() == 0


# --- ranked search ----------------------------------------------------------------------------------------------------


def brute_ranks(docs, items, k=10):
    import math
    import re

    def terms(x):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in x or "")
        return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low)

    have = [(i, terms(t)) for i, t in docs]
    have = [(i, t) for i, t in have if t]
    n_docs, n_words = len(have), sum(len(t) for _, t in have)
    df = {}
    for _, t in have:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in dict.fromkeys(items):
        if item is None:
            continue
        scores = []
        for at, (i, t) in enumerate(have):
            m = 100 - 90 + 90 * len(t) * n_docs // n_words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (1000000000 * t.count(x) // (1000 * t.count(x) + 8 * m)) for x in set(terms(text)) if x in t)
            if s > 0 and i is not None:
                scores.append((-s, i, at))
        out += [(item, r + 1, i, -s) for r, (s, i, _) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def search_docs():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)] + ["É", "é", "Ab", "AB", "ab-ab", "日本", "x\x7fy"]
    docs = [(i * 3 % 601, " ".join(rng.choice(words[: rng.choice([3, 20, 67])]) for _ in range(rng.choice([0, 1, 5, 40, 400])))) for i in range(601)]
    docs += [(1000 + i, "tie tie w1") for i in range(30)] + [(7, "w1 w2"), (None, "w1 w2 rare"), (2000, None), (2001, "--- !"), (-5, "w5 " * 30_000)]
    items = [(1, "w1 W2, w3 w1"), (2, "tie"), (3, "rare w59"), (4, "nowhere"), (5, None), (6, "!?"), (7, " ".join(words)), (7, "ab"), (8, "É"), (8, "É"), (None, "w1"), (9, "Ab ab AB 日本")]
    return docs, items


@pytest.mark.parametrize(("block", "batch", "sent"), [(8192, 256, 500_000), (50, 3, 500_000), (64, 256, 2)])
def test_ranks_against_brute_force(spark, monkeypatch, block, batch, sent):
    monkeypatch.setattr(impact, "BLOCK", block)
    monkeypatch.setattr(impact, "BATCH", batch)
    monkeypatch.setattr(impact, "TERMS", sent)
    docs, items = search_docs()
    d = spark.createDataFrame([(*x, "t", 1) for x in docs], "doc_id long, text string, term string, score int").repartition(3)
    i = impact.asked(spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, rank int"))
    for vocabulary in (i.select(F.explode("terms").alias("term")).distinct(), None):
        got = sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in impact.search(impact.build(d, vocabulary), i).collect())
        assert got == brute_ranks(docs, items)


def test_carries_and_slices():
    rng = np.random.default_rng(3)
    n = 300
    total = np.zeros((44, 2, 5), np.uint64)
    sums = np.zeros((2, n), np.int64)
    for _ in range(12):
        places = np.flatnonzero(rng.random(n) < rng.choice([0.01, 0.5, 1.0]))
        values = rng.integers(0, 1 << 36, len(places))
        words, planes = impact.sliced(places.astype("<u2"), values)
        rows = np.flatnonzero(rng.random(2) < 0.7)
        impact.add(total, rows, words.astype(np.int64), planes)
        for r in rows:
            sums[r, places] += values
    for r in range(2):
        for p in range(n):
            assert sum(int(total[b, r, p >> 6] >> np.uint64(p & 63)) % 2 << b for b in range(44)) == sums[r, p]


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert impact.search(impact.build(docs), impact.asked(items)).count() == 0
    some = spark.createDataFrame([(1, "a b"), (2, "b")], "doc_id long, text string")
    assert impact.search(impact.build(some), impact.asked(items.limit(0))).count() == 0
    assert [tuple(r) for r in impact.search(impact.build(some), impact.asked(items)).select("item_id", "rank", "doc_id").collect()] == [(1, 1, 1)]
