import random

import pyarrow as pa
from pyspark.sql import functions as F

from maskwright.operators import tagger
from maskwright.operators.detect import detect

FIRST = "Anna Boris Chloé Dieter Elif Farid Greta Hugo Ines Jürgen Klara Luís Mila Nils Olga Pavel Quirin Rosa Sven Tariq".split()
LAST = "Albers Bonnet Costa Duval Ehrlich Fontaine García Huber Ivanova Jansen Keller Łukasz Moreau Novák Öztürk Petit Rossi Schmidt Thomas Ueda".split()
PLACES = "Aachen Bordeaux Cádiz Dresden Evian Firenze Genova Hamburg Innsbruck Jena Köln Lyon Malaga Nantes Oslo Parma".split()
FORMS = "GmbH Ltd SARL SpA Inc".split()


def corpus(n, seed, names):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        parts, spans, at = [], [], 0

        def put(text, kind=None):
            nonlocal at
            if kind:
                spans.append((kind, at, at + len(text)))
            parts.append(text)
            at += len(text)

        for _ in range(rng.randint(0, 5)):
            person, place = f"{rng.choice(names[0])} {rng.choice(names[1])}", rng.choice(names[2])
            kind = rng.randint(0, 4)
            if kind == 0:
                put("Yesterday "), put(person, "PERSON"), put(f" {rng.choice(['met us', 'wrote', 'called'])} in "), put(place, "LOCATION"), put(".\n")
            elif kind == 1:
                put("The contract with "), put(f"{rng.choice(names[1])} {rng.choice(FORMS)}", "ORGANIZATION"), put(" was signed by "), put(person, "PERSON"), put(". ")
            elif kind == 2:
                put("We travel to "), put(place, "LOCATION"), put(" on Monday, The Report is due. ")
            elif kind == 3:
                put("Dear "), put(person, "PERSON"), put(", Thank You for Your Letter. ")
            else:
                put("Nothing Happened Here, and All is Well. ")
        rows.append((i, "".join(parts) if i % 50 else None, spans if i % 50 else []))
    return rows


def split(words, k):
    return [w for i, w in enumerate(words) if i % 4 != k], [w for i, w in enumerate(words) if i % 4 == k]


def test_names_that_were_never_seen_are_found(spark):
    seen, unseen = zip(*(split(x, 1) for x in (FIRST, LAST, PLACES)))
    ddl = "id int, text string, spans array<struct<type:string,start:int,end:int>>"
    model = tagger.train(spark.createDataFrame(corpus(500, 1, seen), ddl).repartition(3), max_windows=400)
    assert {t[2:] for t in model.tags if t != "O"} == {"PERSON", "LOCATION", "ORGANIZATION"}
    held = spark.createDataFrame(corpus(200, 2, unseen), ddl).withColumnRenamed("spans", "gold")
    found = held.withColumn("spans", detect(F.col("text"), [tagger.Tagger(model)]))
    for r in tagger.span_scores(found).collect():
        f1 = 2 * r.tp / (2 * r.tp + r.fp + r.fn)
        assert f1 >= 0.9, r
    assert all(s.text == r.text[s.start : s.end] for r in found.collect() for s in r.spans)


def test_tags_of_windows_and_spans():
    text = "word " * 400 + "\nAnna Keller met\n" + "x" * 10
    at = text.index("Anna")
    made = list(tagger.tagged(text, [{"type": "PERSON", "start": at, "end": at + 11}, {"type": "PERSON", "start": at + 2, "end": at + 4}]))
    assert sum(len(w) for w, _ in made) == len(tagger.tokens(text)) and all(len(w) <= tagger.WINDOW for w, _ in made)
    assert [(w, t) for ws, ts in made for w, t in zip(ws, ts) if t != "O"] == [("Anna", "B-PERSON"), ("Keller", "I-PERSON")]
    assert list(tagger.tagged(" \n", [])) == []


def test_decoding_is_the_best_sequence():
    """Viterbi against all sequences."""
    from itertools import product

    import numpy as np

    rng = np.random.default_rng(5)
    tags = ("B-X", "I-X", "O")
    for _ in range(30):
        model = tagger.Model(tags, rng.normal(size=(1 << tagger.BITS, 3)), rng.normal(size=(4, 3)) + tagger.barred(tags))
        rows = rng.integers(0, 1 << tagger.BITS, (5, tagger.ACTIVE))
        emit = model.weights[rows].sum(axis=1)
        value = lambda s: sum(emit[i, t] + model.moves[3 if i == 0 else s[i - 1], t] for i, t in enumerate(s))
        assert model.decode(rows) == list(max(product(range(3), repeat=5), key=value))


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([("a b", []), (None, None)], "text string, spans array<struct<type:string,start:int,end:int>>")
    model = tagger.train(df)
    assert tagger.spans_of("Anna Keller", model) == [] and tagger.spans_of("", model) == []


def test_labels_as_spans(spark):
    df = spark.createDataFrame([("Zoé and Zoé", {"Zoé": "PERSON"}), (None, {"a": "B"}), ("x", None)], "text string, expected map<string,string>")
    got = [[tuple(s) for s in r.g] for r in df.select(tagger.labelled(F.col("text"), F.col("expected")).alias("g")).collect()]
    assert got == [[("PERSON", 0, 3), ("PERSON", 8, 11)], [], []]


def test_training_takes_the_lowest_windows_from_small_batches(spark, monkeypatch):
    """10,000 rows in one batch made the windows of all of them at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    rows = [(f"{'word ' * (i % 300)}x{i} y{i % 7}", [("A", 0, 4)] if i % 3 == 0 and i % 300 else []) for i in range(1500)]
    df = spark.createDataFrame(rows, "text string, spans array<struct<type:string,start:int,end:int>>").coalesce(2)
    seen = []
    monkeypatch.setattr(tagger, "fit", lambda samples, epochs: seen.extend(samples))
    tagger.train(df, max_windows=90)
    sizes = [r.n for r in df.mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in bs), "n long").collect()]
    assert max(sizes) <= 512 and sum(sizes) == 1500
    made = [x for text, spans in rows for x in tagger.tagged(text, [dict(zip(("type", "start", "end"), s)) for s in spans])]
    each = spark.createDataFrame(made, "words array<string>, tags array<string>").withColumn("h", F.xxhash64("words")).orderBy("h").collect()
    some, plain = ([r for r in each if (set(r.tags) != {"O"}) == k] for k in (True, False))
    assert [w for w, _ in seen] == [r.words for r in [*some[:45], *plain[:45]]]


def test_windows_decoded_together_are_decoded_as_each_alone():
    import numpy as np

    rng = np.random.default_rng(6)
    tags = ("B-X", "B-Y", "I-X", "I-Y", "O")
    model = tagger.Model(tags, rng.normal(size=(1 << tagger.BITS, 5)).astype(np.float32), rng.normal(size=(6, 5)) + tagger.barred(tags))
    texts = ["", "a ^ ^^ b", "\n", *(" ".join(rng.choice(["Anna", "İx", "9-9", "z" * 50], rng.integers(1, 700))) for _ in range(30))]
    want = []
    for t in texts:
        want.append([])
        for _, places in tagger.windows(t, tagger.tokens(t)):
            for (a, b), k in zip(places, model.decode(tagger.features([t[a:b] for a, b in places]))):
                if tags[k][0] == "B":
                    want[-1].append((tags[k][2:], a, b))
                elif tags[k][0] == "I":
                    want[-1][-1] = (*want[-1][-1][:2], b)
    assert tagger.spans_of_all(texts, model) == want


def test_every_window_is_learnt_from(spark):
    """Of 4,008 windows with a span at most 2,000 were learnt from, so types that stand in one row were lost."""
    rows = [(f"item{i} costs alpha{i % 9} today", [("A", len(f"item{i} costs "), len(f"item{i} costs alpha0"))]) for i in range(4000)]
    rare = [(text, [(f"R{k}", text.index(" ") + 1, text.rindex(" "))]) for k, text in enumerate(["an Amber ring", "tall BIRCHES grow", "one c-17 bolt", "via D9x port", "my 5050 coins", "up éé street", "by Xenia Quist herself", "all #ok marks"])]
    model = tagger.train(spark.createDataFrame(rows + rare, "text string, spans array<struct<type:string,start:int,end:int>>"))
    assert [tagger.spans_of(text, model) for text, _ in rare] == [spans for _, spans in rare]


def test_the_model_does_not_depend_on_partitions(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(tagger, "SHARD_CHARS", 12000)
    names = FIRST, LAST, PLACES
    rows = corpus(300, 3, names) * 2  # equal rows are told apart by the key only
    df = spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(rows)], "id int, text string, spans array<struct<type:string,start:int,end:int>>")
    a, b = (tagger.train(df.repartition(n), epochs=3, key=F.col("id")) for n in (1, 5))
    assert a.tags == b.tags and np.array_equal(a.weights, b.weights) and np.array_equal(a.moves, b.moves)
    held = spark.createDataFrame(corpus(100, 4, names), "id int, text string, gold array<struct<type:string,start:int,end:int>>")
    for r in tagger.span_scores(held.withColumn("spans", detect(F.col("text"), [tagger.Tagger(a)]))).collect():
        assert 2 * r.tp / (2 * r.tp + r.fp + r.fn) >= 0.9, r


def test_tokens_that_are_certain_are_left_out_of_no_best_sequence():
    import numpy as np

    rng, tags, certain = np.random.default_rng(7), ("B-X", "B-Y", "I-X", "I-Y", "O"), 0
    for _ in range(200):
        model = tagger.Model(tags, np.zeros((1, 5)), rng.normal(size=(6, 5)) * rng.choice([1, 3]) + tagger.barred(tags))
        sizes = rng.integers(1, 12, rng.integers(1, 9))
        emit = rng.normal(size=(sizes.sum(), 5)) + np.array([0, 0, 0, 0, rng.choice([0, 3, 6, 9])])
        each = np.split(emit, np.cumsum(sizes)[:-1])
        want = [k for e in each for k in tagger.Model(tags, e, model.moves).decode(np.arange(len(e))[:, None])]
        assert model.best(emit, sizes).tolist() == want
        certain += model.outside(emit, sizes).sum()
    assert certain > 500


def test_hashes_and_words_of_windows():
    import zlib

    import numpy as np

    rng = random.Random(8)
    words = ["^", "İx", "ß9", "é" * 300, *("a" * n for n in (255, 256, 257)), *("".join(rng.choices("aB9éİ-_x", k=rng.randint(1, 40))) for _ in range(1500))]
    tables = tagger.Hashes()
    ids = tables.ids(words)
    rows = tagger.word_rows(tables.filled().parts[ids], np.array(tables.of_form), tables.longs(ids))
    for word, own in zip(words, rows):
        w, form = word.lower(), tagger.shape(word)
        names = f"w{w}", f"s{form}", f"p{w[:3]}", f"e{w[-3:]}", f"n{min(len(w), 20)}", f"<{w}", f">{w}", f"a{form}", f"b{form}", f"2{w}", f"3{w}"
        assert own.tolist() == [zlib.crc32(x.encode()) & ((1 << tagger.BITS) - 1) for x in names]
    each = [words[k : k + 160] for k in range(0, len(words), 160)]
    group = tagger.Group.unpacked(tagger.Group.of([tables.ids(x) for x in each], tables).packed())
    weights = np.random.default_rng(9).normal(size=(1 << tagger.BITS, 3))
    assert all(np.array_equal(group.rows(k), tagger.features(x)) for k, x in enumerate(each))
    assert np.allclose(group.emit(weights), np.concatenate([weights[tagger.features(x)].sum(axis=1) for x in each]))
    for text in ["", "\n", *("".join(rng.choices(["ab ", "\n", "x", "- "], [60, 1, 20, 19], k=rng.randint(1, 3000))) for _ in range(60))]:
        assert list(tagger.words_of(text)) == [(lo, [text[a:b] for a, b in places]) for lo, places in tagger.windows(text, tagger.tokens(text))]
