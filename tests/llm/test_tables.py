"""Mixing, WARC, top-k and HTML."""

import base64
import hashlib
import io
import random
import re
import struct
import time

import duckdb
import numpy as np
import pytest
import zstandard

from maskwright.llm import html, mixing, topk, warc
from maskwright.llm.common import fresh_path

# --- mixing -----------------------------------------------------------------------------------------------------------


def test_rows_that_are_alike_are_spread(spark):
    """20,000 equal rows fall into many buckets; the numbers do not depend on how the table is cut."""
    docs = spark.createDataFrame([(1, "a b c", "s")] * 5000 + [(None, "x", None)] * 700 + [(i, "d e", "s") for i in range(2, 300)], "doc_id long, text string, source string")
    sized = docs.select("doc_id", mixing.F.xxhash64("doc_id", "text").alias("__h"))
    for n in (1, 7):
        cut = sized.coalesce(n).withColumns({"__row": mixing.F.monotonically_increasing_id(), "__part": mixing.F.spark_partition_id()})
        got = mixing.numbered_repeats(cut).collect()
        assert sorted(r["__nth"] for r in got if r.doc_id == 1) == list(range(5000)) and sorted(r["__nth"] for r in got if r.doc_id is None) == list(range(700))
        assert {r["__nth"] for r in got if r.doc_id not in (1, None)} == {0}
    got = mixing.taken(docs).collect()
    assert len(got) == 5998 and sum(r.taken for r in got) > 0 and all(r.taken <= 2 * r.size for r in got)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000])
def test_permutations_are_bijections(n):
    p = mixing.permutation(3, 1, n, 17)
    x = p(np.arange(n))
    assert sorted(x) == list(range(n)) and (p.inverse(x) == np.arange(n)).all()


def test_water_fill():
    rng = random.Random(1)
    for _ in range(200):
        sizes = [rng.choice([0, 1, 10, 1000, 50_000]) for _ in range(rng.randint(1, 9))]
        weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
        total = sum(sizes) * 1.5
        got = mixing.water_fill(sizes, weights, total)
        assert abs(sum(got) - total) < 1e-6 * (total + 1)
        assert all(g <= 2 * s + 1e-9 for g, s in zip(got, sizes, strict=True))
        free = [g / w for g, s, w in zip(got, sizes, weights, strict=True) if g < 2 * s - 1e-9]
        assert not free or max(free) - min(free) < 1e-6 * (max(free) + 1)
        capped = [g / w for g, s, w in zip(got, sizes, weights, strict=True) if g >= 2 * s - 1e-9]
        assert not free or not capped or max(capped) <= max(free) + 1e-6


def mixed(spark, docs, **settings):
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, __size int")
    return mixing.taken(df, **settings).collect()


def test_sources_meet_their_targets(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 80, 700])), rng.choice(["a"] * 6 + ["b", "c", "d", None]), 1) for i in range(300)] + [(400, None, "b", 1), (401, " \n", "zz", 1)]
    got = mixed(spark, docs, length=32, slots=16)
    again = {(r.doc_id, r.taken) for r in mixed(spark, docs, length=32, slots=16)}
    assert again == {(r.doc_id, r.taken) for r in got} and len(got) == len(docs)
    by = {}
    sources = {d[0]: d[2] for d in docs}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.size == len((dict((d[0], d[1]) for d in docs)[r.doc_id] or "").split())
        by.setdefault(sources[r.doc_id], []).append(r)
    for name, rows in by.items():
        assert sum(r.size for r in rows) == rows[0].source_size
        assert sum(r.taken for r in rows) == int(rows[0].target + 0.5), name
    assert abs(sum(rows[0].target for rows in by.values()) - 1.5 * sum(r.size for r in got)) < 1e-6


def test_mixed_texts_hold_what_is_taken(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice(["\n", " ", "  "]).join(f"w{i}_{k}" for k in range(rng.choice([0, 3, 50, 120]))), rng.choice("abc"), i) for i in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, n_chars int")
    want = {r.doc_id: r.taken for r in mixing.taken(df, length=16, slots=8).collect()}
    got = {}
    out = mixing.mixed_texts(df, length=16, slots=8)
    assert out.columns == df.columns
    for r in out.collect():
        words = r.text.split()
        assert len(set(words)) == len(words) and set(words) <= set(docs[r.doc_id][1].split()) and r.n_chars == len(r.text)
        got[r.doc_id] = got.get(r.doc_id, 0) + len(words)
    assert got == {i: n for i, n in want.items() if n}


def test_slots_take_each_block_once_a_turn(spark):
    sources = mixing.plan({"a": 1000, "b": 333, None: 2500}, 32, 17)
    rows = mixing.slot_table(spark, sources, 32, 8, 17).collect()
    assert len({(r.shard, r.slot) for r in rows}) == len(rows) == sum(s.draws for s in sources)
    seen = [(r["__source"], r.turn, r.block) for r in rows]
    assert len(set(seen)) == len(seen)
    for s in sources:
        assert sum(r.words for r in rows if r["__source"] == s.index) == int(s.target + 0.5)


def test_taken_by_brute_force(spark):
    """Every word of every source, laid out where placed() says, counted slot by slot."""
    rng = random.Random(9)
    docs = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 80, 700])), rng.choice(["a"] * 6 + ["b", "c", None])) for i in range(250)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows, _, sources = mixing.mix(df, length=32, slots=16)
    owner = {s.index: [None] * s.size for s in sources}
    for r in rows.collect():
        for k in range(r["__start"], r["__start"] + r["__size"]):
            assert owner[r["__source"]][k] is None
            owner[r["__source"]][k] = r.doc_id
    want = dict.fromkeys(range(250), 0)
    for r in mixing.slot_table(spark, sources, 32, 16, 17).collect():
        for i in owner[r["__source"]][r.block * 32 : r.block * 32 + r.words]:
            want[i] += 1
    assert {r.doc_id: r.taken for r in mixing.taken(df, length=32, slots=16).collect()} == want


@pytest.mark.parametrize("sizes", [(256, 4096), (3, 2)])
def test_running_totals_by_shelves(spark, monkeypatch, sizes):
    monkeypatch.setattr(mixing, "SHELF", sizes[1])
    rng = random.Random(4)
    rows = [(rng.choice("ab"), i // sizes[0], i, rng.randint(0, 9)) for i in range(100)]
    got = mixing.running(spark.createDataFrame(rows, "g string, b int, o int, v int"), ["g"], "b", ["o"], "v", "upto").collect()
    assert sorted((r.g, r.o, r.upto) for r in got) == sorted((g, o, sum(x[3] for x in rows if x[0] == g and x[2] < o)) for g, _, o, _ in rows)


def test_mixing_edges(spark):
    assert mixed(spark, []) == []
    assert [(r.size, r.taken) for r in mixed(spark, [(1, None, None, 1)])] == [(0, 0)]
    twice = mixed(spark, [(1, "a b c", "s", 1), (1, "a b c", "s", 1), (None, "x", "s", 1)], length=2)
    assert sum(r.taken for r in twice) == int(twice[0].target + 0.5) and len(twice) == 3


# --- WARC -----------------------------------------------------------------------------------------------------------------


def brute_pages(pages):
    first = {}
    for i, _, h, *_ in pages:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(first.get(b, i), i)
    for i, _, h, *_ in pages:
        b = (h or "").encode()
        f = first.get(b)
        revisit = f is not None and f != i
        yield i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", f if revisit else None


def test_archives_round_trip(spark):
    rng = random.Random(1)
    bodies = ["", "short", "x" * 99, "x" * 100, "é" * 50, "é" * 49 + "a", "<p>" + "long " * 50_000, "\r\n\r\nWARC/1.1\r\n\r\n" * 9]
    pages = [(i, rng.choice(["http://a.example/x", "http://b.example/a b\r\nX: y", None]), rng.choice(bodies), 1) for i in rng.sample(range(1000), 120)] + [(None, None, None, 1), (None, "u", "x" * 100, 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, payload int").repartition(3)
    folder = fresh_path(spark, "warc")
    manifest = warc.write_archives(df, folder, rotate=5_000)
    assert manifest.count() > 3
    for r in manifest.collect():  # the files themselves: a skippable frame, then the frames
        with open(r.path, "rb") as f:
            data = f.read()
        assert len(data) == r.bytes and data[:4] == struct.pack("<I", warc.SKIPPABLE)
        assert sum(1 for _ in warc.read_archive(io.BytesIO(data))) == r.records
    got = warc.read_archives(manifest, folder)
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()), key=key) == sorted(brute_pages(pages), key=key)
    texts = {p[0]: (p[2] or "").encode() for p in pages if p[0] is not None}
    for r in got.filter("page_id is not null").collect():
        assert (r.payload is None) == (r.record_type == "revisit") and (r.payload is None or bytes(r.payload) == texts[r.page_id])


def test_empty_pages(spark):
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string"), spark).count() == 0


def archive_of(records, dictionary=b""):
    c = zstandard.ZstdCompressor(dict_data=warc.loaded_dictionary(dictionary) if dictionary else None)
    return (warc.dictionary_frame(dictionary) if dictionary else b"") + b"".join(c.compress(r) for r in records)


def test_dictionaries_and_chunks():
    records = [warc.record_bytes(i, f"http://x/{i}", f"<html>{'page ' * i}</html>".encode(), None, False, "2024-01-01T00:00:00Z") for i in range(60)]
    trained = warc.train_dictionary(records * 5, 4096)
    assert trained[:4] == struct.pack("<I", warc.DICTIONARY)
    for d in (b"", b"http://x/ <html>page page", trained):
        data = archive_of(records, d)
        for chunk in (1, 7, 1 << 20):
            got = [warc.page_of(r.headers["warc-record-id"]) for r in warc.read_archive(io.BytesIO(data), chunk=chunk)]
            assert got == list(range(60))


@pytest.mark.parametrize("damage", ["cut", "flip", "length", "crlf", "header", "twice", "version", "dictionary"])
def test_damage_is_found(damage):
    good = warc.record_bytes(1, "http://x/", b"hello", None, False, "2024-01-01T00:00:00Z")
    bad = {"length": good.replace(b"Content-Length: ", b"Content-Length: 9", 2), "crlf": good[:-2], "header": good.replace(b"WARC-Date", b"X-Date"), "twice": good.replace(b"WARC-Date: ", b"WARC-Type: x\r\nWARC-Date: "), "version": good.replace(b"WARC/1.1", b"WARC/9.9"), "flip": good.replace(b"hello", b"hullo")}
    data = archive_of([good, bad.get(damage, good)], b"some dictionary bytes" * 9)
    if damage == "cut":
        data = data[:-3]
    if damage == "dictionary":
        data = data[:20]
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(data)))


def test_archives_of_others(spark, tmp_path):
    """Records of all types, SHA-1 digests in base32, ids of other kinds, no manifest, a folder named file:/..."""
    b32 = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n<p>hi"

    def record(kind, content_type, block, **more):
        head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{kind}>", "WARC-Date": "2024-01-01T00:00:00Z", "Content-Type": content_type, "Content-Length": str(len(block)), "WARC-Block-Digest": "sha1:" + b32(block)} | more
        return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"

    made = [record("warcinfo", "application/warc-fields", b"software: x\r\n"), record("request", "application/http; msgtype=request", b"GET / HTTP/1.1\r\n\r\n"), record("response", "application/http; msgtype=response", http, **{"WARC-Payload-Digest": "sha1:" + b32(b"<p>hi")}), record("metadata", "text/plain", b"a: b")]
    (tmp_path / "a.warc.zst").write_bytes(archive_of(made))
    for folder in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}"):
        df = spark.createDataFrame([(f"{tmp_path}/a.warc.zst",)], "path string")
        got = {r.record_type: r for r in warc.read_archives(df, folder).collect()}
        assert list(got) == ["warcinfo", "request", "response", "metadata"] and all(r.page_id is None for r in got.values())
        assert bytes(got["response"].payload) == b"<p>hi" and got["response"].payload_digest == hashlib.sha256(b"<p>hi").hexdigest()
    with pytest.raises(ValueError):
        list(map(warc.http_payload, warc.read_archive(io.BytesIO(archive_of([record("response", "application/http", http, **{"WARC-Payload-Digest": "sha1:" + b32(b"no")})])))))


# --- top-k -------------------------------------------------------------------------------------------------------------------


def brute_topk(rows, k=5):
    good = [(i, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    for q, a in {(i, tuple(v)): (i, v) for i, v in good if i % 50 == 0}.values():
        found = sorted(((-int(a @ b), i) for i, b in good if i != q and len(b) == len(a)))[:k]
        for rank, (s, i) in enumerate(found, 1):
            yield q, rank, i, -s


def test_exact_topk(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(size=12) * rng.choice([0.1, 1, 30])]) for i in range(700)]
    rows += [(i, rows[5][1]) for i in range(800, 812)] + [(900, None), (950, []), (1000, [1.0, None] * 6), (1050, [float("nan")] * 12), (1100, [float("inf")] * 12), (None, [1.0] * 12), (1150, [1.0, 2.0, 3.0]), (1151, [1.0, 2.0, -3.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(5)
    vectors = topk.whole(df)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    for size in (7, 4096):
        got = topk.search(vectors.filter("id % 50 = 0"), vectors, query_rows=4, candidate_rows=size)
        assert sorted(map(tuple, got.collect())) == sorted(brute_topk(rows))


def test_large_and_repeated_ids(spark):
    big = 50 * (2**62 // 50)
    rows = [(big, [1.0, 2.0]), (big, [1.0, 2.0]), (50, [1.0, 0.0]), (50, [0.0, -1.0]), (2, [3.0, 1.0]), (2, [3.0, 1.0]), (-7, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = topk.whole(df)
    got = sorted(map(tuple, topk.search(v.filter("id % 50 = 0"), v, query_rows=2, candidate_rows=2).collect()))
    assert got == sorted(brute_topk(rows)) and len(got) == 5 + 5 + 5  # two queries of id 50, one of the large id
    c = duckdb.connect()
    c.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    c.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    assert sorted(c.execute(topk.OP7_SQL).fetchall()) == got


def test_grid_follows_the_blocks():
    for q, c, cores in ((1, 1, 8), (3, 40, 8), (200, 5000, 8), (40_000, 250_000, 1000)):
        a, b = topk.grid(q, c, cores)
        assert -(-q // a) <= topk.HELD and b <= c and (a * b >= 4 * cores or b == c)
        assert q * c / (a * b) <= topk.PAIRS or b == c


def test_fewer_than_k_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (50, [3.0])], "vec_id long, embedding array<float>")
    v = topk.whole(df)
    assert sorted(map(tuple, topk.search(v.filter("id % 50 = 0"), v).collect())) == [(0, 1, 50, 256 * 768), (0, 2, 1, 256 * 512), (50, 1, 1, 768 * 512), (50, 2, 0, 768 * 256)]
    assert topk.search(v.filter("id < 0"), v).count() == 0


def test_bounds_hold_and_cut_work():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 64)) * 2
    v = np.floor(256 * (centres[rng.integers(0, 8, 3000)] + rng.normal(size=(3000, 64)) * 0.1)).astype(np.int64)
    q = v[:20]
    for a, b in zip(topk.statistics(q), topk.statistics(v), strict=True):
        assert (a @ b.T >= q @ v.T - 1e-3).all()
    best = topk.Best(np.arange(20), q, 5)
    for lo in range(0, 3000, 500):
        best.see(np.arange(lo, lo + 500), v[lo : lo + 500], topk.statistics(v[lo : lo + 500]))
    assert best.examined < 0.6 * 20 * 3000
    for r in range(20):
        want = sorted((-int(q[r] @ v[i]), i) for i in range(3000) if i != r)[:5]
        assert list(zip((-best.scores[r]).tolist(), best.found[r].tolist(), strict=True)) == want


@pytest.mark.parametrize("dim", [1, 2, 3, 5, 6, 7, 12, 30, 64])
def test_bounds_hold_in_any_dimension(dim):
    v = np.random.default_rng(dim).integers(-500, 500, (60, dim))
    bounds = [a @ b.T for a, b in zip(topk.statistics(v[:20]), topk.statistics(v), strict=True)]
    assert all((x >= v[:20] @ v.T - 1e-3).all() for x in bounds)
    assert len(bounds) == len(topk.levels(dim + -dim % 4)) and (len(bounds) < 2 or bounds[-1].sum() <= bounds[0].sum())


def test_bounds_cut_work_on_the_table(spark):
    """The embeddings point in all directions alike: the segments of two still drop a good part of the pairs."""
    rows = topk.whole(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")).orderBy("id").collect()
    ids, v = np.array([r.id for r in rows]), np.array([r.v for r in rows], np.int64)
    asked = ids % 50 == 0
    best = topk.Best(ids[asked], v[asked], 5)
    for lo in range(0, len(v), 256):
        best.see(ids[lo : lo + 256], v[lo : lo + 256], topk.statistics(v[lo : lo + 256]))
    assert best.examined < 0.65 * asked.sum() * len(v)
    for r, q in enumerate(np.flatnonzero(asked)):
        want = sorted((-int(v[q] @ v[i]), ids[i]) for i in range(len(v)) if i != q)[:5]
        assert list(zip((-best.scores[r]).tolist(), best.found[r].tolist(), strict=True)) == want
    print("examined", best.examined / (asked.sum() * len(v)))


# --- HTML -------------------------------------------------------------------------------------------------------------------------

CASES = {
    "<p>a<b>b</p>c": "ab\n\nc",
    "<ul><li>one<li>two<ol start=3><li>x<li>y</ol></ul>": "- one\n- two\n  3. x\n  4. y",
    "<table><tr><th>Name<th>Qty<tr><td>apple pie<td>3<tr><td colspan=2>all of these things</table>": "Name       Qty\napple pie  3\nall of these things",
    "<table><tr><td rowspan=2>r<td>1<tr><td>2</table>": "r  1\n   2",
    "<table><td>x</td></table>": "x",
    "<div hidden>no</div><span style='display: none'>no</span>yes<i style=visibility:hidden>no</i>": "yes",
    "<style>.ad, #x{display:none} @media print{.b{display:none}}</style><p class='big ad'>no<p id=x>no<p class=b>yes": "yes",
    "<pre>\n a  b\n   c</pre>": " a  b\n   c",
    "<details><summary>S</summary>hid<p>den</details><details open><summary>T</summary>seen</details>": "S\nT\nseen",
    "x<br>y<br><br>z": "x\ny\n\nz",
    "&amp; &lt;q&gt; &eacute; &#233; a<2": "& <q> é é a<2",
    "a<!-- <p>no --> b<!DOCTYPE x>": "a b",
    "<script>var t='</p>';</script><title>no</title>t<textarea>\n<b>kept</b></textarea>": "t\n<b>kept</b>",
    "<p title=it's>ok": "ok",
    '<a b="c>d" e>f</a>': "f",
    "<head><title>no</title><p>yes": "yes",
    "<select><option>a<option>b</select>": "a\nb",
    "<dl><dt>t<dd>d</dl>": "t\n  d",
    "<blockquote>q</blockquote>": "  q",
    "a<p></p><p>b": "a\n\nb",
    "<table><tr><td><p>a</p><p>b</p><td>c</table>": "a  c\nb",
    "": "",
    "<": "<",
    "<a href=\"x": "",
    "</p>x": "x",
}


@pytest.mark.parametrize("page", CASES)
def test_rendering(page):
    assert html.extract_text(page) == CASES[page]


SHOWN = {
    "<style>.tab{display:none} .tab.active{display:block}</style><div class=tab>no</div><div class='tab active'>a<b>b</b></div>": "ab",
    "<style>.x{display:none}</style><p class=x style='display:block'>yes<p class=x>no": "yes",
    "<style>#i{display:block} .x{display:none} .y{display:none} .y{display:inline}</style><p id=i class=x>one<p class=y>two": "one\n\ntwo",
    "<style>.x{display:none!important}</style><p class=x style='display:block'>no<p>yes": "yes",
    "<div style='visibility:hidden'>no<p>no<b style='visibility: visible'>yes</b>no</div>": "yes",
    "<style>.x{display:none;display:nonsense}</style><p class=x>no</p>yes": "yes",
    "<style>[hidden]{} div{display:flex}</style><div hidden>yes</div><p hidden>no": "yes",
    "<math><mi>x</mi><mo>=</mo><mn>2</mn></math>": "x=2",
    "a <svg><title>no</title><defs/>no<path d=x /><g><text>one</text><text>two</text></g></svg>b": "a one two b",
    "<svg><foreignObject><p>yes</p></foreignObject></svg>": "yes",
    "<map><a href=x>link</a><area></map><object data=x><param name=y>fallback</object>": "linkfallback",
}


SHOWN |= {
    "<style>div p{display:none}</style><div><b><p>no</b></div><p>yes": "yes",
    "<style>div > p{display:none}</style><div><p>no</p><b><p>yes</b></div>": "yes",
    "<style>.a .b > .c{display:none} .c{visibility:visible}</style><div class=a><i class=b><i class=c>no</i></i><i class=c>yes</i></div>": "yes",
    "<style>#x .y{display:none} div .y{display:block}</style><div id=x><span class=y>no</span></div><div><span class=y>yes</span></div>": "yes",
    "<style>@media screen{.m{display:none}} @media print{.n{display:none}}</style><p class=m>no<p class=n>yes": "yes",
    "<style>a+b{display:none} a:hover{display:none}</style><a>x</a><b>y</b>": "xy",
    "<map><p>hello map</p></map>": "hello map",
}


@pytest.mark.parametrize("page", SHOWN)
def test_what_shows_is_kept(page):
    assert html.extract_text(page) == SHOWN[page]


def test_visibility_by_brute_force():
    """Random trees and rules; what shows by looking through all rules and all ancestors for each element."""
    rng = random.Random(12)

    def fits(compound, node):
        tag, classes, ids = re.match(r"([a-z]*)", compound)[1], set(re.findall(r"[.]([a-z])", compound)), set(re.findall(r"#([a-z])", compound))
        return (not tag or tag == node["tag"]) and classes <= set(node["class"]) and ids <= {node["id"]}

    def matches(tokens, node):
        if not fits(tokens[-1], node):
            return False
        if len(tokens) == 1:
            return True
        rest, child = (tokens[:-2], True) if tokens[-2] == ">" else (tokens[:-1], False)
        up = node["up"]
        while up is not None:
            if matches(rest, up):
                return True
            up = None if child else up["up"]
        return False

    def weight(tokens):
        plain = [t for t in tokens if t != ">"]
        return sum(t.count("#") for t in plain), sum(t.count(".") for t in plain), sum(t[0].isalpha() for t in plain)

    compound = lambda: rng.choice(["div", "span", "b", ""]) + rng.choice(["", ".x", ".y", "#i", ".x.y"]) or ".z"
    for n in range(300):
        rules = []
        for _ in range(rng.randint(1, 8)):
            tokens = [compound()]
            for _ in range(rng.choice([0, 0, 1, 2])):
                tokens = [compound(), *rng.choice([[], [">"]]), *tokens]
            rules.append((tokens, *rng.choice([("display", "none"), ("display", "none"), ("display", "inline"), ("visibility", "hidden"), ("visibility", "visible")]), rng.random() < 0.1))
        want, words = [], 0

        def make(up, depth, shown):
            nonlocal words
            out = ""
            for _ in range(rng.randint(1, 3)):
                node = {"tag": rng.choice(["div", "span", "b"]), "class": rng.sample("xyz", rng.randint(0, 2)), "id": rng.choice(["", "", "i"]), "up": up}
                inline = rng.choice(["", "", "", "display:none", "display:block", "visibility:visible"])
                found = [((important, 0, *weight(tokens), k), name, value) for k, (tokens, name, value, important) in enumerate(rules) if matches(tokens, node)]
                if inline:
                    found.append(((False, 1, 0, 0, 0, 0), *inline.split(":")))
                style = {name: value for _, name, value in sorted(found)}
                gone = shown is None or style.get("display") == "none"
                now = None if gone else {"visible": True, "hidden": False}.get(style.get("visibility"), shown)
                words += 1
                if now:
                    want.append(f"w{words}")
                out += f"<{node['tag']} class='{' '.join(node['class'])}' id='{node['id']}' style='{inline}'> w{words} " + (make(node, depth + 1, now) if depth < 4 else "") + f"</{node['tag']}> "
            return out

        html_tag = {"tag": "html", "class": [], "id": "", "up": None}
        body = make(html_tag, 0, True)
        css = " ".join(f"{' '.join(t)}{{{a}:{b}{'!important' if i else ''}}}" for t, a, b, i in rules)
        assert html.extract_text(f"<style>{css}</style>{body}").split() == want, (css, body)


@pytest.mark.parametrize(
    "page",
    [
        "<em>" + "<div>" * 60_000 + "</em>" * 60_000,
        "<style>" + "".join(f".c{i}{{display:none}}" for i in range(60_000)) + "</style>" + "".join(f"<p class=c{i + 1}>x" for i in range(60_000)),
        "<style>" + "p{display:none}" * 60_000 + "</style>" + "<p>x" * 60_000,
        "<style>" + "".join(f".a .b{i}{{display:none}}" for i in range(30_000)) + "</style><i class=a>" + "".join(f"<p class=b{i}>x" for i in range(60_000)),
        "<div>" * 30_000 + "<body x=y>" * 60_000 + "<a><b>" * 30_000 + "</a>" * 60_000,
        "<table>" + "<tr><td>a<td>b" * 30_000 + "<tr><td>" + "x" * 300_000 + "</table>",
        "<table><tr><td>a<td>b" * 30_000,
        "<ul><li>x" * 60_000 + "<blockquote>y" * 60_000,
        "<p><button>" * 30_000 + "</p>" * 60_000 + "<li><ul>" * 20_000 + "</li>" * 20_000,
    ],
    ids="inline classes same chains body table nested indent walls".split(),
)
def test_hostile_pages_take_linear_time(page):
    began = time.perf_counter()
    out = html.extract_text(page)
    assert time.perf_counter() - began < 10 and len(out) < 30 * len(page) + 10_000


def test_wide_cells_are_aligned():
    long = "word " * 40 + "end"
    out = html.extract_text(f"<table><tr><td>{long}<td>b<tr><td>c<td>d</table>").split("\n")
    assert out[0].index("b", len(long)) == out[1].index("d") == len(long) + 2


def test_html_is_linear_in_depth_and_length():
    deep = "<div>" * 50_000 + "deep" + "<table><tr><td>" * 3000 + "x"
    assert "deep" in html.extract_text(deep)
    html.extract_text("<p x='" * 20_000)
    html.extract_text("</b>" * 50_000 + "<b>" * 50_000 + "<!--" * 1000)


def test_no_text_is_lost():
    rng = random.Random(1)
    tags = "p b div span ul ol li table tr td th h1 br a section dl dt dd tbody caption em".split()
    for _ in range(400):
        page, words = "", []
        for k in range(rng.randint(1, 25)):
            tag = rng.choice(tags)
            page += rng.choice([f"<{tag}>", f"</{tag}>", f"<{tag} class=x>"]) + " "
            if rng.random() < 0.7:
                words.append(f"w{k}w")
                page += f"w{k}w "
        got = html.extract_text(page).split()
        assert sorted(x for x in got if x.startswith("w")) == sorted(words), page


def test_html_table(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, "<p>a", "x"), (None, "<p>a", "x")], "page_id long, html string, text string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in html.extract(df).collect()) == [(0, "a", 1), (1, "", 0), (1, "a", 1)]
    assert html.extract(df.limit(0)).count() == 0


# --- pipeline -----------------------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("bcdfgmnp") + rng.choice("aeiou") for _ in range(3))
    docs, labels = [], []
    for i in range(240):
        text = " ".join(word() for _ in range(60))
        if i % 8 == 0:
            text += " you idiot"
        if i % 8 == 1:
            text += f" mail a{i}@mail.example.com"
        if i % 8 == 2 and i > 8:
            text = docs[i - 8][1]  # a copy
        docs.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(i % 8 == 0)))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "encoding":
            assert out.columns == now.columns, name
            out.write.parquet(f"{tmp_path}/{name}.parquet")
            now = spark.read.parquet(f"{tmp_path}/{name}.parquet")
            kept[name] = now.collect()
    assert {r.doc_id for r in kept["toxicity"]} == {i for i in range(240) if i % 8}
    assert {r.doc_id for r in kept["near-dedup"]} == {i for i in range(240) if i % 8 and (i % 8 != 2 or i < 8)}
    assert not any("@" in r.text for r in kept["pii"]) and len(kept["pii"]) == len(kept["near-dedup"])
    size = sum(len(r.text.split()) for r in kept["pii"])
    assert abs(sum(len(r.text.split()) for r in kept["mixing"]) - 1.5 * size) < 3
    final = out.collect()
    assert len(final) == len(kept["mixing"]) and all(r.round_trip for r in final)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(final)
    assert {r.n_chars for r in kept["mixing"]} == {len(r.text) for r in kept["mixing"]}
