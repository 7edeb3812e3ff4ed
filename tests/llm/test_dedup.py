"""Near-dedup against brute force over all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from maskwright.llm import dedup
from maskwright.llm.common import utf8
from maskwright.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set()


def brute(docs, width, percent=80):
    sets = {i: shingles(t, width) for i, t in docs}
    up = {i: i for i, _ in docs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def corpus(n=160, seed=3):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("xyz")
    base = [" ".join(word() for _ in range(rng.choice([1, 3, 5, 40, 80, 200]))) for _ in range(n // 4)]
    texts = []
    for _ in range(n):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, max(1, len(words) // 20))):
            words[rng.randrange(len(words))] = word()
        texts.append(rng.choice([" ", "\n", "  "]).join(words).upper() if rng.random() < 0.2 else " ".join(words))
    # a chain: neighbours are linked, ends are not
    chain = [word() + str(i) for i in range(120)]
    texts += [" ".join(chain[k : k + 80]) for k in range(0, 40, 4)]
    texts += ["", " \n", None, "one", "One", "one two", "é É"]
    return list(enumerate(texts, 10))


@pytest.mark.parametrize("chunk", [dedup.CHUNK, 150])
def test_components_match_brute_force(spark, chunk):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in dedup.near_duplicates(df, width=4, chunk=chunk).collect()}
    assert got == brute(docs, 4)


def test_repeats_nulls_and_other_columns(spark):
    docs = [(1, "a b c d e", 5), (1, "a b c d e", 5), (None, "a b c d e", 6), (None, "x y z w v", 7), (2, None, 8), (2, None, 8), (3, "a b c d e", 9)]
    df = spark.createDataFrame(docs, "doc_id long, text string, node int")
    rows = sorted([(r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in dedup.near_duplicates(df, width=4).collect()], key=str)
    assert rows == sorted([(1, 2, 1, True), (1, 2, 1, True), (-1, 2, 1, False), (-1, 2, None, True), (2, 0, 2, True), (2, 0, 2, True), (3, 2, 1, False)], key=str)
    kept = sorted((tuple(r) for r in dedup.drop_near_copies(spark, df, "").collect()), key=str)
    assert kept == sorted([(1, "a b c d e", 5), (None, "x y z w v", 7), (2, None, 8), (2, None, 8)], key=str)


def test_many_rows_without_ids_meet_only_their_own_texts(spark):
    """Near copies without ids, with one id, and a text that a third of all rows repeat."""
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join([*words, f"x{i}"]) for i in range(300)] + ["one text that is here again and again"] * 150
    for doc_id in (None, 7):
        df = spark.createDataFrame([(doc_id, t) for t in texts], "doc_id long, text string").repartition(3)
        got = dedup.near_duplicates(df)
        assert got.count() == 450 and {r.component_id for r in got.collect()} == {doc_id}
        assert dedup.drop_near_copies(spark, df, "").count() == 2


def test_superseded_tables_are_deleted(spark):
    import os

    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(shared))
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    dedup.near_duplicates(df, width=4, chunk=150).count()
    left = {n.rsplit("-", 1)[0] for n in set(os.listdir(shared)) - before}
    assert left <= {"dedup-sketch", "dedup-components", "dedup-labels", "dedup-links", "cc-labels"} and "dedup-sets" not in left


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert dedup.near_duplicates(df).count() == 0 and dedup.drop_near_copies(spark, df, "").count() == 0


def test_sets_of_a_batch_do_not_depend_on_neighbours():
    texts = [t or "" for _, t in corpus()]
    data, off = utf8(pa.array(texts))
    for t, s in zip(texts, dedup.shingle_sets(data, off, 4), strict=True):
        d, o = utf8(pa.array([t]))
        assert (dedup.shingle_sets(d, o, 4)[0] == s).all() and len(s) == len(shingles(t, 4))


def test_min_max_slots_estimate_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64))
    b = np.unique(np.concatenate([a[:800], rng.integers(0, 2**63, 200).astype(np.uint64)]))
    s = dedup.signatures([a, b], 256)
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.08


def test_graph_components(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(0, 300)] + [(rng.randint(1000, 1200), rng.randint(1000, 1200)) for _ in range(150)] + [(5000, x) for x in range(5001, 5300)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in got} and {x for a, b in edges if a != b for x in (a, b)} <= got.keys()
