"""Toxicity, fingerprints, personal data, SentencePiece and language ID."""

import hashlib
import random
import re
import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.llm import fingerprint, langid, pieces, pii, toxicity


# --- toxicity -------------------------------------------------------------------------------------------------------


def toxic_corpus(spark, n=400):
    rng = random.Random(1)
    plain = ["".join(rng.choice("bcdfg") + rng.choice("aeiou") for _ in range(3)) for _ in range(200)]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(plain, k=30)
        bad = i % 7 == 0
        if bad:
            words[3] = rng.choice(["idiot", "zorgling", "zorgfest"])
        docs.append((i, " ".join(words), "en"))
        if i % 2 == 0:
            labels.append((i, 1, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string, p_toxic string"), spark.createDataFrame([*labels, (None, 1, 1), (4, 1, None)], "doc_id long, quality int, toxic int")


def test_chain_learns_words_and_stems(spark):
    docs, labels = toxic_corpus(spark)
    chain = toxicity.train(docs, labels)
    assert chain.names == ["insult", "contempt", "toxic"]
    got = {r.doc_id: r for r in toxicity.score(docs, chain).collect()}
    assert all(r.toxic == (i % 7 == 0) for i, r in got.items())
    assert all(0 <= r.p_insult <= 1 and 0 <= r.p_toxic <= 1 for r in got.values())
    more = spark.createDataFrame([(1, None), (1, None), (2, ""), (3, "x " * 200_000 + "zorgblatt"), (4, "you IDIOT")], "doc_id long, text string")
    assert sorted((r.doc_id, r.toxic) for r in toxicity.score(more, chain).collect()) == [(1, False), (1, False), (2, False), (3, True), (4, True)]


def test_few_labels_in_every_language(spark):
    rng = random.Random(3)
    docs, bad = [], {}
    for lang, n, letters, stem in (("en", 200, "bcdf", "zorg"), ("de", 48, "ghkl", "lowei"), ("fr", 32, "mnpr", "vequa"), ("es", 32, "stvw", "chlla")):
        plain = ["".join(rng.choice(letters) + rng.choice("aeiou") for _ in range(4)) for _ in range(150)]
        for i in range(n):
            words = rng.choices(plain, k=30)
            if i % 8 == 0:
                words[5] = stem + rng.choice(plain)
            bad[len(docs)] = i % 8 == 0
            docs.append((len(docs), " ".join(words), lang))
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(b)) for i, b in bad.items()], "doc_id long, toxic int")
    got = {r.doc_id: r.toxic for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert got == bad


def test_later_models_see_out_of_fold_predictions():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 40))  # noise that a model can learn by heart
    y = (rng.random(200) < 0.5).astype(float)
    chain = toxicity.fit_chain(x, [("a", y), ("b", y)], l2=0.01)
    first, second = chain[0][1], chain[1][1]
    seen = 1 / (1 + np.exp(-(x @ first[:-1] + first[-1])))
    assert np.corrcoef(seen, y)[0, 1] > 0.25  # by heart
    trusting = toxicity.fit_logistic(np.hstack([x, seen[:, None]]), y, 0.01)
    assert len(second) == 42 and second[40] < trusting[40]  # the chain does not trust it as far


def test_withheld_words_are_no_feature():
    """No word of a category's list, nor anything made from it, reaches that category's columns."""
    lean = {w: ((5.0, 5.0),) * 3 for w in ("idiot", "idio-", "scum", "plain")}
    some = toxicity.features_of("an idiot and scum")
    assert "idio-" not in some and "idio-" in toxicity.features_of("idiotic")
    with_seed = toxicity.design(some, {w: lean[w] for w in some & lean.keys()})
    without = toxicity.design(some - {"idiot"} | {"x"}, {w: lean[w] for w in some & lean.keys() - {"idiot"}})
    assert (with_seed[0] == without[0]).all() and not (with_seed[1] == without[1]).all() and not (with_seed[2] == without[2]).all()


def test_designs_of_many_texts_by_brute_force():
    rng = random.Random(2)
    word = lambda: rng.choice(["idiot", "idiotic", "scum", "scummy", "tree", "treetop", "unknown", "zorgling", "zorgfest", "a"])
    names = {lang: sorted({x for w in ("idiot", "idiotic", "scummy", "treetop", "zorgling", "scum")[k:] for x in toxicity.features_of_word(w)}) for k, lang in enumerate(("", "en", "de"))}
    values = {lang: np.array([[[rng.choice([-1, 0, 0.5, 2, 3]), rng.random()] for _ in range(3)] for _ in n], np.float32) for lang, n in names.items()}
    chain = toxicity.Chain({lang: {w: i for i, w in enumerate(n)} for lang, n in names.items()}, values, ())
    texts = [" ".join(word() for _ in range(rng.choice([0, 1, 5, 60]))) for _ in range(80)]
    langs = [rng.choice(["", "en", "de", "xx"]) for _ in texts]
    got = chain.design(texts, langs)
    for t, lang, x in zip(texts, langs, got, strict=True):
        lang = lang if lang in names else ""
        leaning = {f: values[own][names[own].index(f)].tolist() for f in toxicity.features_of(t) for own in [lang if f in names[lang] else ""] if f in names[own]}
        assert np.allclose(x, toxicity.design(toxicity.words_of(t), leaning)), t
    assert (chain.design(texts[::-1], langs[::-1])[::-1] == got).all()


def test_chain_by_brute_force():
    """Every model and every out-of-fold prediction, fitted one by one; and a chain that tells more than single models do."""
    rng = np.random.default_rng(3)
    n = 300
    hidden = rng.random(n) < 0.4
    x = np.zeros((n, 3, toxicity.WIDTH))
    x[:, 0, 0] = hidden + 0.3 * rng.normal(size=n)  # the first category alone sees the cause
    x[:, 1:, 1] = rng.normal(size=(n, 2))
    y = np.stack([hidden, hidden, hidden], axis=1).astype(float)
    chain = toxicity.fit_chain(x, [(c, y[:, k]) for k, c in enumerate(toxicity.CATEGORIES)], folds=5, l2=0.1)
    earlier = np.zeros((n, 0))
    for k in range(3):
        both = np.hstack([x[:, k], earlier])
        assert np.allclose(chain[k][1], toxicity.fit_logistic(both, y[:, k], 0.1))
        unseen = np.zeros(n)
        for i in range(5):
            rows = np.arange(n) % 5 == i
            w = toxicity.fit_logistic(both[~rows], y[~rows, k], 0.1)
            unseen[rows] = 1 / (1 + np.exp(-np.clip(both[rows] @ w[:-1] + w[-1], -30, 30)))
        earlier = np.hstack([earlier, unseen[:, None]])
    gain = toxicity.chain_gain(x, y)
    assert gain["contempt"][0] < 0.5 * gain["contempt"][1] and gain["toxic"][0] < 0.5 * gain["toxic"][1]


def test_without_usable_labels_seed_words_decide(spark):
    docs, _ = toxic_corpus(spark, 20)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, none)
    got = toxicity.score(spark.createDataFrame([(1, "such trash"), (2, "fine")], "doc_id long, text string"), chain)
    assert {r.doc_id: r.toxic for r in got.collect()} == {1: True, 2: False}
    assert toxicity.score(docs.limit(0), chain).count() == 0


# --- fingerprints -----------------------------------------------------------------------------------------------------


def edits(docs):
    order = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0)))
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        t, nxt = t or "", nxt or ""
        half = len(t) // 2
        yield i, len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()


@pytest.mark.parametrize("n", [0, 1, 2, 97])
def test_edited_texts(spark, n):
    rng = random.Random(n)
    docs = [(i * 3 % 101, "".join(rng.choice("abc é😀\n") for _ in range(rng.choice([0, 1, 2, 9, 300])))) for i in range(n)]
    docs = [(i, t or (None if rng.random() < 0.5 else "")) for i, t in docs]
    got = [(r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprint.compare_edits(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()]
    assert sorted(got) == sorted(edits(docs))


def test_null_and_equal_ids(spark):
    docs = [(None, "a b c"), (None, None), (7, "same text here"), (7, "same text here"), (3, "x")]
    got = fingerprint.compare_edits(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(got) == 5 and len({r.fingerprint for r in got if r.doc_id == 7}) == 1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_shared_substrings_share_phrases_at_any_offset():
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    like = lambda a, b: fingerprint.likeness([a], fingerprint.signatures([a]), [b], fingerprint.signatures([b]))[0]
    assert like(text, text) == 1
    for k in (1, 2, 3, 17):
        assert like(text, "z" * k + text) > 0.85  # an offset changes the edges alone
    half = text[:1500] + "".join(rng.choice("ijklmnop ") for _ in range(1500))
    assert 0.15 < like(text, half) < 0.55
    assert like(text, "".join(rng.choice("ijklmnop ") for _ in range(3000))) < 0.05
    assert like("", "") == 1 and like("", "a") == 0 and like("aaaa" * 50, "aaaa" * 50) == 1


def test_fingerprints_do_not_depend_on_the_batch():
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab c") for _ in range(rng.choice([0, 1, 2, 3, 10, 500]))) for _ in range(60)]
    together = fingerprint.signatures(texts)
    assert all((fingerprint.signatures([t])[0] == s).all() for t, s in zip(texts, together, strict=True))


# --- personal data --------------------------------------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_base(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(t):
        digits = re.sub("[ -]", "", m[0])
        if 12 <= len(digits) <= 19 and sum(int(d) if k % 2 == 0 else (2 * int(d) - 9 * (int(d) > 4)) for k, d in enumerate(reversed(digits))) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_match_the_patterns():
    rng = random.Random(1)
    for _ in range(8000):
        t = "".join(rng.choice("ab@@..--  +()0123456789129é") for _ in range(rng.randint(0, 60)))
        assert sorted(map(tuple, pii.base_spans(t))) == sorted(brute_base(t)), t


def test_long_runs_stay_linear():
    for t in ("1" * 200_000, "1." * 100_000, "a" * 200_000 + "@", "+1" + "-" * 200_000, "@" * 100_000, "1 " * 100_000):
        pii.base_spans(t)
        pii.further_candidates(t, [])


def personal(spark):
    rng = random.Random(2)
    hexes = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    docs = []
    for i in range(300):
        t = " ".join(rng.choice(["lorem", "ipsum", "dolor", "x"]) for _ in range(20))
        if i % 3 == 0:
            t += f' token = "{hexes()}" and'
        if i % 3 == 1:
            t += " averylongwordwithoutanysense" + "x" * (i % 7)
        if i % 10 == 0:
            t += f" a{i}@mail.example.com 10.0.0.{i % 256} 4111111111111111 +1 (523) 555-1055"
        docs.append((i, t))
    return docs, spark.createDataFrame([(i, t, 1, "k") for i, t in docs], "doc_id long, text string, n_chars long, t string")


def test_weak_supervision_adds_secrets(spark):
    docs, df = personal(spark)
    model = pii.train(df)
    got = {r.doc_id: r for r in pii.find(df, model).collect()}
    for i, t in docs:
        base = brute_base(t)
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert got[i].base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        n = Counter(k for k, _, _ in base)
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(n[k] for k in pii.BASE)
        spans = [s.split(":") for s in got[i].spans.split(",") if s]
        assert {tuple(s) for s in spans} >= {(k, str(a), str(b)) for k, a, b in base}
        assert ("secret" in {s[0] for s in spans}) == (i % 3 == 0)


def iban(rng):
    body = "".join(rng.choice("0123456789") for _ in range(18))
    rest = int(body + "131400") % 97  # DE00
    return f"DE{98 - rest:02d}{body}"


def test_ibans_and_ssns(spark):
    rng = random.Random(6)
    good, bad = [iban(rng) for _ in range(40)], [iban(rng) for _ in range(40)]
    bad = [b[:2] + f"{(int(b[2:4]) + 40) % 97:02d}" + b[4:] for b in bad]
    texts = [f"konto {x} bitte" for x in good] + [f"part {x}/x" for x in bad] + [f"her ssn {rng.randint(100, 600)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)} was" for _ in range(40)] + [f"order 000-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}/x" for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find(df, pii.train(df)).collect()}
    assert all("iban:6:28" in got[i] for i in range(40)) and not any("iban" in got[i] for i in range(40, 80))
    assert all("ssn:8:19" in got[i] for i in range(80, 120)) and not any("ssn" in got[i] for i in range(120, 160))


def test_people(spark):
    rng = random.Random(7)
    first, last = ["Anna", "Peter", "Maria", "Hans"], ["Lorem", "Ipsumer", "Dolorin"]
    texts = [f"so Dr. {rng.choice(first)} {rng.choice(last)} said" for _ in range(40)] + [f"dear {rng.choice(first)} {rng.choice(last)}, hello" for _ in range(40)] + [f"contact Quux/{i} for more" for i in range(60)] + ["regards Zzyzx_9 there"] * 20 + ["The Lorem Dolor is a place"] * 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find(df, pii.train(df)).collect()}
    assert all("person" in got[i] for i in range(80)) and not any("person" in got[i] for i in range(80, 180))
    votes = {pii.votes(t, s) for t in texts for s in pii.further_candidates(t, [])}
    assert all(len({v[k] for v in votes}) > 1 for k in range(len(pii.LABELERS)))  # no labeler always says the same


def test_the_sample_keeps_proportions_when_rows_repeat(spark):
    docs, df = personal(spark)
    many = df
    for _ in range(3):
        many = many.unionByName(many)
    rows = spark.createDataFrame([(i, t) for i, t in docs] + [(900 + i, docs[0][1]) for i in range(500)], "doc_id long, text string")
    models = [pii.train(x, max_rows=60) for x in (df, many, rows)]
    found = [{r.doc_id: r.spans for r in pii.find(df, m).distinct().collect()} for m in models]
    assert found[0] == found[1] == found[2]


def test_phone_beside_other_digits(spark):
    texts = [f"call +1 (826) 555-{4000 + i} now" for i in range(30)] + ["+1 (826) 555-4081 190.137.223.204 ok", "+49 30 555 4082 1234567890 ok", "+1 (826) 555-40812 190.137.223.204"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = pii.train(df)
    got = {r.doc_id: r for r in pii.find(df, model).collect()}
    assert got[30].n_phone == got[31].n_phone == 0  # base spans stay as they are
    assert got[30].spans == "phone:0:17,ip:18:33" and got[30].n_further == 1
    assert got[31].spans == "phone:0:15"
    assert "phone" not in got[32].spans
    out = {r.doc_id: r.text for r in pii.mask(df, model).collect()}
    assert out[30] == "[PHONE] [IP] ok" and out[31] == "[PHONE] 1234567890 ok"


def test_masking_keeps_everything_else(spark):
    docs, df = personal(spark)
    texts = dict(docs)
    out = pii.mask(df, pii.train(df))
    assert out.columns == df.columns
    for r in out.collect():
        assert not brute_base(r.text) and r.n_chars == len(r.text) and r.t == "k"
        if r.doc_id % 3 == 2 and r.doc_id % 10:
            assert r.text == texts[r.doc_id]
    assert pii.masked("ab 12 cd", [pii.Span("card", 3, 5), pii.Span("phone", 4, 7)]) == "ab [CARD]d"


def test_aggregation_tells_reliable_labelers():
    rng = random.Random(3)
    counts = Counter()
    truth = Counter()
    for _ in range(4000):
        y = rng.random() < 0.4
        noisy = lambda right: (1 if y else -1) * (1 if rng.random() < right else -1)
        v = (noisy(0.95), noisy(0.9), noisy(0.5), 0, noisy(0.85))
        counts["secret", v] += 1
        truth["secret", v] += y
    p, tables = pii.aggregate(counts)
    assert sum(counts[k] * abs(p[k] - truth[k] / counts[k]) for k in counts) / 4000 < 0.08
    t = tables["secret"]
    assert t[0, 2, 1] > 0.85 and abs(t[2, 2, 1] - 0.5) < 0.15


def test_candidates_of_any_length_and_script():
    """Brute force over what is put into a text: every secret and name is a candidate, whole."""
    rng = random.Random(12)
    secrets = ["a1B2" * 40, "ab12" * 5, "Z9" * 5000, "eyJhbGciOi0.eyJzdWIiOiIx_x.SflKxw-RJSM_eKKF2"]
    names = ["Łukasz Nowak", "Élodie Ñúñez", "Ольга Иванова", "Anna O’Brien-Šmíd", "Örjan Ålund", "Maximilian-Alexander Schwarzenbergerinnen"]
    for _ in range(50):
        secret, name = rng.choice(secrets), rng.choice(names)
        text = f"é {rng.choice(['key=', 'token ', ''])}{secret}{rng.choice([' ', ', ', chr(10)])}{rng.choice(['Mr', 'Frau', 'Dear'])} {name}, and so on"
        got = {(s.kind, text[s.start : s.end]) for s in pii.further_candidates(text, pii.base_spans(text))}
        assert ("secret", secret) in got and ("person", name) in got, (text, got)
    assert pii.known_name("Élena") and pii.known_name("LUKAS") and not pii.known_name("Table")
    assert ("person", "Andréa Šmíd") in {(s.kind, t[s.start : s.end]) for t in ["we met Andréa Šmíd there"] for s in pii.further_candidates(t, [])}


def test_pii_edges(spark):
    df = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "a@b.cd")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.n_email, r.spans) for r in pii.find(df, pii.train(df)).collect())
    assert got == [(0, 0, ""), (1, 0, ""), (1, 0, ""), (2, 1, "email:0:6")]
    assert pii.find(df.limit(0), pii.train(df.limit(0))).count() == 0
    assert [r.text for r in pii.mask(df, pii.Model(None)).orderBy(F.col("doc_id").asc_nulls_first(), "text").collect()] == [None, "", "", "[EMAIL]"]


# --- SentencePiece ----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def machine():
    with open(pieces.MODEL, "rb") as f:
        return pieces.Transducer(f.read())


def test_encoding_equals_the_library(machine):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(3)
    alphabet = "ab \n\t▁éß😀日本語the of ing  <s></s><0x0A>ÀЖ　.,*&"
    texts = ["", " ", "  ", "▁", "a", "Hello  world\n\tfoo  ", "\x00", "ab" * 3000, "日本語" * 500, " x", "x "]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += [" ".join(rng.choice(["internationalization", "unbelievably", "straße", "l'été", "don't", "---", "1234567", "foo_bar(baz)"]) for _ in range(8)) for _ in range(200)]
    for t in texts:
        assert list(machine.encode(t)) == library.encode(t), t
        assert machine.decode(machine.encode(t)) == t.replace("▁", " ")
        ids = [rng.randrange(len(machine.pieces)) for _ in range(5)]
        assert machine.decode([i for i in ids if i > 2]) == library.decode([i for i in ids if i > 2])


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def rebuilt(kind, normaliser=None):
    """The model's own pieces as a model of another kind or with another normaliser. Unigram scores fall with the logarithm of
    the place, so that there are hardly ties."""
    out, place = b"", 0
    for number, value in pieces.fields(open(pieces.MODEL, "rb").read()):
        if number == 1:
            place += 1
            if kind == pieces.UNIGRAM:
                value += bytes([2 << 3 | 5]) + struct.pack("<f", -5 - 1.7 * np.log(place))
        if number == 2:
            value += bytes([3 << 3, kind])  # the last value of a field counts
        if number == 3 and normaliser is not None:
            value = normaliser
        out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


WORDS = ["internationalization", "unbelievably", "straße", "l'été", "don't", "---", "1234567", "foo_bar(baz)", "日本語", "😀", "x" * 70, "ﬁnal", "Ａ１"]


@pytest.mark.parametrize("kind", [pieces.UNIGRAM, pieces.MERGES])
@pytest.mark.parametrize("rule", [None, "nmt_nfkc", "nfkc_cf"])
def test_other_models_equal_the_library(kind, rule):
    import sentencepiece

    spec = None if rule is None else sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec()
    model = rebuilt(kind, spec)
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    machine = pieces.Transducer(model)
    rng = random.Random(5)
    alphabet = "ab \n\t▁éß😀日本語the of ing  ÀЖ　.,*&ﬁＡ½é"
    texts = ["", " ", "  ", "a", "Hello  world ", "ab" * 300, "日本語" * 100, "x" * 500, " ﬁ  Ａ "]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(600)]
    texts += [rng.choice([" ", "  "]).join(rng.choice(WORDS) for _ in range(8)) for _ in range(200)]
    weight = lambda ids: sum(float(machine.weight[i]) for i in ids)
    for t, ids in zip(texts, machine.encode_all(texts), strict=True):
        want = library.encode(t)
        if list(ids) != want:  # "a aa" or "aa a": equal sums but for rounding, which starts anew in each part here
            assert kind == pieces.UNIGRAM and len(ids) == len(want) and abs(weight(ids) - weight(want)) < 1e-3, t
        assert machine.decode(ids) == machine.shown(t)


def test_shortest_path_by_brute_force():
    """All ways to spell short texts with pieces, by total weight."""
    machine = pieces.Transducer(rebuilt(pieces.UNIGRAM))
    ids = {p: i for i, p in enumerate(machine.pieces) if p in machine.rank}

    def least(t):
        if not t:
            return 0.0
        return min(float(machine.weight[ids[t[:k]]]) + least(t[k:]) for k in range(1, len(t) + 1) if t[:k] in ids)

    rng = random.Random(6)
    for t in ["".join(rng.choice("theingsaor") for _ in range(rng.randint(1, 9))) for _ in range(60)]:
        for got in (machine.relax([t])[0], machine.relax_long(t)):
            assert abs(sum(float(machine.weight[i]) for i in got) - least(t)) < 1e-3 and "".join(machine.pieces[i] for i in got) == t


def test_refused_models():
    for kind in (3, 4):  # words, characters
        with pytest.raises(ValueError):
            pieces.Transducer(rebuilt(kind))


def test_forgetting_changes_nothing(machine, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 5)
    monkeypatch.setattr(pieces, "PAIRS", 8)
    monkeypatch.setattr(pieces, "CELLS", 40)
    fresh = pieces.Transducer(open(pieces.MODEL, "rb").read())
    for t in ("the quick brown fox jumps over the lazy dog " * 3, "x" * 500, "one two three", "the quick four", "é日 " * 9):
        assert fresh.encode(t) == machine.encode(t)


def test_columns_with_clashing_names(spark):
    """Every operator's inner and outer names as columns of the input."""
    extra = ["th", "k0", "t", "l", "x", "y", "node", "nth", "part", "edge", "spans", "found", "token_ids", "held_out", "toxic", "h", "lang_pred", "fingerprint", "chunk", "grp", "label"]
    rows = [(i, f"some plain words {i} and more of them here", "en", *[str(i)] * len(extra)) for i in range(12)]
    df = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "lang string", *(f"{c} string" for c in extra)]))
    bare = df.select("doc_id", "text", "lang")
    same = lambda f: sorted(map(tuple, f(df).collect()), key=str) == sorted(map(tuple, f(bare).collect()), key=str)
    assert same(fingerprint.compare_edits) and same(fingerprint.fingerprints) and same(pieces.encode)
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int")
    chain, model, found = toxicity.train(bare, labels), langid.train(bare), pii.train(bare)
    assert same(lambda d: toxicity.score(d, chain)) and same(lambda d: langid.identify(d, model)) and same(lambda d: pii.find(d, found))
    assert same(lambda d: pii.mask(d, found).select("doc_id", "text", "lang")) and pii.mask(df, found).columns == df.columns
    from maskwright.llm import dedup

    assert same(dedup.near_duplicates)
    kept = dedup.drop_near_copies(spark, df, "")
    assert kept.columns == df.columns and kept.count() == dedup.drop_near_copies(spark, bare, "").count()


def test_encoding_tables(spark):
    df = spark.createDataFrame([(1, "Hello world"), (1, "Hello world"), (None, None), (2, ""), (3, "é " * 50_000)], "doc_id long, text string")
    got = pieces.encode(df)
    rows = got.collect()
    assert all(r.round_trip and r.n_tokens == len(r.token_ids) for r in rows) and len(rows) == 5
    assert sorted((r.text or "") for r in pieces.decode(got).collect()) == sorted((r.text or "") for r in df.collect())
    assert pieces.encode(df.limit(0)).count() == 0


# --- language ID -------------------------------------------------------------------------------------------------------------


def spoken(spark, n=400):
    rng = random.Random(4)
    parts = {"en": ["th", "ing", "ed", "wh", "er"], "de": ["sch", "ung", "ü", "keit", "ie"], "fr": ["eau", "é", "qu", "ou", "è"]}
    docs = []
    for i in range(n):
        lang = rng.choice(list(parts))
        docs.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(30)), lang if i % 9 else None, lang))
    return spark.createDataFrame([d[:3] for d in docs], "doc_id long, text string, lang string"), {d[0]: d[3] for d in docs}


def test_held_out_accuracy(spark):
    docs, truth = spoken(spark)
    got = {r.doc_id: r for r in langid.identify(docs, langid.train(docs)).collect()}
    import zlib

    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
    assert sum(r.lang_pred == truth[i] for i, r in got.items() if r.held_out) >= 0.97 * sum(r.held_out for r in got.values())


def test_predictions_by_brute_force(spark):
    """Every n-gram of the whole text looked up one by one; strange texts are rejected, learnt ones are not."""
    docs, _ = spoken(spark)
    model = langid.train(docs)
    rng = random.Random(5)
    texts = ["".join(rng.choice("thingwerschüéà ,1") for _ in range(rng.choice([1, 3, 40, 3000]))) for _ in range(40)] + ["λόγος καὶ ἀριθμός " * 20, "слово и дело " * 20]
    rows = [(i, t, i, "x") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, score long, lang_pred string"), model).collect()}
    for i, t in enumerate(texts):
        raw = np.frombuffer(t.encode(), np.uint8)
        z = np.mean([model.logits[g] for h in langid.hashed(raw, len(model.logits)) for g in h], axis=0) + model.bias
        p = np.exp(z / model.temperature - max(z / model.temperature))
        p /= p.sum()
        if langid.has_letter(t):
            assert abs(got[i].score - p.max()) < 1e-4 and p[model.langs.index(got[i].lang_pred)] > p.max() - 1e-4
            assert got[i].rejected == (got[i].score < model.floor)
    assert got[40].rejected and got[41].rejected and 1 / len(model.langs) < model.floor < 1
    known = [r.rejected for r in langid.identify(docs, model).collect()]
    assert sum(known) <= 0.05 * len(known)


def test_windows_cover_whole_texts_and_ids_of_any_kind(spark):
    """The only words that tell the languages apart stand at the end of long texts."""
    rng = random.Random(9)
    rows = [(f"d{i}", " ".join(rng.choice(["lorem", "ipsum"]) for _ in range(400)) + (" kette kette" if i % 2 else " chaine chaine") * 20, "de" if i % 2 else "fr") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id string, text string, lang string")
    got = langid.identify(df, langid.train(df, max_windows=3000)).collect()
    assert sum(r.lang_pred == rows[int(r.doc_id[1:])][2] for r in got) >= 190


def test_ties_go_to_the_smaller_code(spark):
    model = langid.Model(("de", "en"), np.zeros((1 << 10, 2), np.float32), np.zeros(2), 1.0, 0.0)
    assert [(r.lang_pred, r.score) for r in langid.identify(spark.createDataFrame([(1, "any text")], "doc_id long, text string"), model).collect()] == [("de", 0.5)]


def test_labels_of_held_out_rows_are_not_read(spark):
    docs, _ = spoken(spark, 120)
    wrong = docs.withColumn("lang", F.when(langid.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    a, b = langid.train(docs), langid.train(wrong)
    assert a.langs == b.langs and (a.logits == b.logits).all()


def test_language_edges(spark):
    docs, _ = spoken(spark, 120)
    model = langid.train(docs)
    more = spark.createDataFrame([(1, None), (1, None), (2, ""), (3, "12 ² !!"), (None, "thing wher"), (5, "thing " * 100_000)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.lang_pred) for r in langid.identify(more, model).collect())
    assert got == [(0, "en"), (1, "und"), (1, "und"), (2, "und"), (3, "und"), (5, "en")]
    assert langid.train(docs.limit(0)) is None and langid.identify(docs.limit(0), None).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.limit(3), None).collect()} == {"und"}


def test_row_sums_do_not_cross_rows():
    import pyarrow as pa

    from maskwright.llm.common import utf8

    rng = np.random.default_rng(0)
    m = langid.Model(("a", "b"), rng.random((1 << 10, 2)).astype(np.float32), np.zeros(2), 1.0, 0.0)
    texts = ["", "a", "ab", "abc", "abcd", "hello world", "é", ""]
    data, off = utf8(pa.array(texts))
    z = langid.row_logits(data, off, m)
    for t, row in zip(texts, z, strict=True):
        grams = langid.hashed(np.frombuffer(t.encode(), np.uint8), 1 << 10)
        want = m.logits[np.concatenate(grams)].mean(axis=0) if t else np.zeros(2)
        assert np.abs(row - want).max() < 1e-5
