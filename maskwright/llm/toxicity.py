"""Toxicity by classifier chains.

Categories are predicted one after the other: insult, contempt, toxic. Each is a linear (logistic) model over which seed words
are present, a summary of how the text's words lean towards the category, and the probabilities of the categories before it;
in training these are out-of-fold predictions.

The labels table has one toxicity label, the last category. The earlier ones are labelled by lists of seed words, and what
defines a category is withheld from its model: neither its own seed words nor anything made from them is among its features.
So it learns what goes along with such words (other words, and relatives of the same stem), and its probability tells the later
models something that their own features do not.

Words and word beginnings lean by their smoothed log-odds among the labelled documents of the text's language (of all
languages, where that language lacks the word); every one in `least_docs` documents that leans by `least_odds` counts, whatever
their number. While fitting, leanings and earlier probabilities are counted without the document's own part, so that they are
as wrong as on new texts.

Bounds: at most `max_rows` labelled documents (those with the smallest hash of doc_id) are used for fitting; every document
is scored, over its whole text.

Defined cases. Null text: as empty. Null label or doc_id in labels: that label is not used; several labels of a document:
the largest. No usable label, or one class only: the last category falls back to the seed words alone. Empty tables give
an empty result. Repeated documents are scored each. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import fit_logistic, logistic, lowest, map_arrow, prepare, saved, strings, table

WORD = re.compile(r"[^\W\d_]+")

#: Seed words of the categories that no table labels.
SEEDS = {
    "insult": "idiot moron loser clown fool dumb stupid imbecile".split(),
    "contempt": "scum trash worthless pathetic disgusting garbage vermin".split(),
}


SEED_WORDS = [w for ws in SEEDS.values() for w in ws]
ALL_SEEDS = frozenset(SEED_WORDS)

#: The chain. What a category may not see: its own seed words.
CATEGORIES = (*SEEDS, "toxic")
WITHHELD = tuple(frozenset(SEEDS.get(c, ())) for c in CATEGORIES)

#: Columns that design() adds to the seed words.
SUMMARY = 7
WIDTH = len(SEED_WORDS) + SUMMARY

#: Lengths of word beginnings that count as features too: many languages build insults from a stem.
STEMS = (4, 5, 6, 7)

#: Words that a task remembers for each language, about 250 bytes each.
REMEMBERED = 40_000

#: Parts of the labelled documents: the leaning of a document's features is counted over the other parts while fitting.
PARTS = 5


@dataclass(frozen=True)
class Chain:
    """places: for each language ('' for all together) the row of each feature in values; values: (row, category, 2) the log-odds
    towards the category, and those times the share of the category's documents that hold the feature.
    models: one (name, weights) for each category in order; the weights cover the columns of design(), then the earlier
    categories, then the bias.
    known: for each language words with the rows of their features; chains with the same places may share it."""

    places: dict[str, dict[str, int]]
    values: dict[str, np.ndarray]
    models: tuple[tuple[str, np.ndarray], ...]
    known: dict[str, dict[str, tuple[int, ...]]] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return [name for name, _ in self.models]

    @cached_property
    def tables(self) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """For each language the values of its own features, then those of all together; and which of them a category may not see."""
        out = {}
        for lang in self.places:
            values = self.values[lang] if lang == "" else np.concatenate([self.values[lang], self.values[""]])
            hidden = np.zeros(values.shape[:2], bool)
            for k, words in enumerate(WITHHELD):
                hidden[[row for w in words for row in self.rows(w, lang)], k] = True
            out[lang] = values, hidden
        return out

    def rows(self, word: str, lang: str) -> tuple[int, ...]:
        """Where a word's features are in the language's table: those of the language, or else those of all together."""
        own, pooled = self.places[lang], self.places[""]
        below = 0 if lang == "" else len(self.values[lang])
        return tuple(own[x] if x in own else pooled[x] + below for x in features_of_word(word) if x in own or x in pooled)

    def design(self, texts: list[str], langs: list[str]) -> np.ndarray:
        """(text, category, column): design() of each text, for all texts of a language together."""
        out = np.zeros((len(texts), len(CATEGORIES), WIDTH))
        by_lang: dict[str, list[int]] = {}
        for i, lang in enumerate(langs):
            by_lang.setdefault(lang if lang in self.places else "", []).append(i)
        for lang, rows in by_lang.items():
            values, hidden = self.tables[lang] if self.places else (np.zeros((0, len(CATEGORIES), 2)), np.zeros((0, len(CATEGORIES)), bool))
            known = self.known.setdefault(lang, {})
            if len(known) > REMEMBERED:
                known.clear()
            found: list[list[int]] = []
            for i in rows:
                words = words_of(texts[i])
                if self.places:
                    for w in words.difference(known):
                        known[w] = self.rows(w, lang)
                    found.append(list(set(chain.from_iterable(map(known.__getitem__, words)))))
                else:
                    found.append([])
                out[i, :, -1] = len(words)
                for w in ALL_SEEDS & words:
                    out[i, :, SEED_WORDS.index(w)] = [w not in x for x in WITHHELD]
            doc, at = np.repeat(np.array(rows), [len(f) for f in found]), np.fromiter(chain.from_iterable(found), np.int64)
            for k in range(len(CATEGORIES)):
                use = (values[at, k, 0] > 0) & ~hidden[at, k]
                self.summary(out[:, k], doc[use], values[at[use], k])
        out[:, :, -1] = np.log1p(out[:, :, -1]) / 4
        return out

    def forget(self) -> None:
        """At the end of a task: the worker goes on with other work."""
        self.known.clear()
        self.__dict__.pop("tables", None)

    @staticmethod
    def summary(out: np.ndarray, doc: np.ndarray, values: np.ndarray) -> None:
        """The SUMMARY columns of design() from the leanings (document, value) of one category; the last holds the number of
        words."""
        for j in range(2):
            order = np.lexsort((-values[:, j], doc))
            d, v = doc[order], values[order, j].astype(float)
            nth = np.arange(len(d)) - np.searchsorted(d, d)
            out[d[nth == 0], 2 * j - SUMMARY] = v[nth == 0]
            out[:, 2 * j + 1 - SUMMARY] += np.bincount(d[nth < 5], v[nth < 5] / 5, minlength=len(out))
        out[:, 4 - SUMMARY] = np.minimum(out[:, 2 - SUMMARY], 1)
        out[:, 5 - SUMMARY] += 4 * np.bincount(doc, values[:, 0].astype(float), minlength=len(out)) / np.maximum(out[:, -1], 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of all categories, for rows of design()."""
        out = np.zeros((len(x), 0))
        for k, (_, w) in enumerate(self.models):
            p = logistic(x[:, k] @ w[:WIDTH] + out @ w[WIDTH:-1] + w[-1])
            out = np.hstack([out, p[:, None]])
        return out


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def features_of_word(w: str) -> list[str]:
    """The word, and beginnings of it, marked by a hyphen; seed words have no beginnings, so that nothing made from them is left
    where they are withheld."""
    return [w] if w in ALL_SEEDS else [w, *(f"{w[:k]}-" for k in STEMS if len(w) > k)]


def features_of(text: str) -> set[str]:
    return {x for w in words_of(text) for x in features_of_word(w)}


def design(words: set[str], leaning: dict[str, tuple[tuple[float, float], ...]]) -> np.ndarray:
    """A row for each category. Presence of the seed words; then, of the log-odds and of those times the share, the highest and
    the mean of the five highest; the highest of the latter up to 1, as one clear word is enough; the sum of the log-odds for
    each word; and the length, which lets a model allow for what chance gives in a long text. What is withheld counts for
    nothing."""
    out = np.zeros((len(CATEGORIES), WIDTH))
    seeds = ALL_SEEDS & words
    for k, hidden in enumerate(WITHHELD):
        for w in seeds - hidden:
            out[k, SEED_WORDS.index(w)] = 1
        found = [v[k] for w, v in leaning.items() if v[k][0] > 0 and w not in hidden]
        summary = []
        for j in range(2):
            top = heapq.nlargest(5, (x[j] for x in found))
            summary += [max(top, default=0.0), sum(top) / 5]
        out[k, -SUMMARY:] = [*summary, min(summary[2], 1.0), 4 * sum(x[0] for x in found) / max(len(words), 1), math.log1p(len(words)) / 4]
    return out


def seeded(features: set[str]) -> list[int]:
    """The labels of the categories that seed words define."""
    return [int(not features.isdisjoint(ws)) for ws in SEEDS.values()]


def fit_chain(x: np.ndarray, labels: list[tuple[str, np.ndarray]], folds: int = 5, l2: float = 1.0) -> tuple[tuple[str, np.ndarray], ...]:
    """x: (row, column), or (row, category, column) if the categories see different columns; labels: (category, 0/1 per row) in
    chain order. Row i is in fold i mod folds."""
    fold = np.arange(len(x)) % folds
    earlier = np.zeros((len(x), 0))
    models = []
    for c, (name, y) in enumerate(labels):
        both = np.hstack([x if x.ndim == 2 else x[:, c], earlier])
        models.append((name, fit_logistic(both, y, l2)))
        unseen = np.zeros(len(x))
        for k in range(folds):
            inside, out = fold != k, fold == k
            if inside.any() and out.any():
                w = fit_logistic(both[inside], y[inside], l2)
                unseen[out] = logistic(both[out] @ w[:-1] + w[-1])
        earlier = np.hstack([earlier, unseen[:, None]])
    return tuple(models)


def log_odds(a, b, p, q):
    """Smoothed log-odds of a feature in a of p toxic and b of q other documents: how far it leans, whatever the table's size."""
    return np.log((a + 0.5) / (p + 1)) - np.log((b + 0.5) / (q + 1))


@dataclass(frozen=True)
class Counts:
    """Of one language: labelled rows (part, kind), the row of each feature, and rows with the feature (feature, part, kind). Kind
    0 is all rows, the others the categories."""

    rows: np.ndarray
    places: dict[str, int]
    held: np.ndarray


def count_features(labelled: DataFrame, least_docs: int, least_odds: float) -> dict[str, Counts]:
    """For each language, and '' for all together, its features that lean towards some category."""
    kinds = 1 + len(CATEGORIES)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        n: Counter = Counter()
        for t, lang, part, y in zip(strings(batch.column("text")), strings(batch.column("lang")), batch.column("part").to_pylist(), batch.column("y").to_pylist(), strict=True):
            features = features_of(t)
            cells = [part * kinds, *(part * kinds + 1 + k for k, one in enumerate([*seeded(features), y]) if one)]
            for w in ("", *features):
                for c in cells:
                    n[lang, w, c] += 1
        return pa.RecordBatch.from_pydict({"lang": [k[0] for k in n], "word": [k[1] for k in n], "cell": pa.array([k[2] for k in n], pa.int32()), "n": pa.array(n.values(), pa.int64())})

    names = [f"c{c}" for c in range(kinds * PARTS)]
    cells = [F.sum(F.when(F.col("cell") == c, F.col("n")).otherwise(0)).cast("int").alias(name) for c, name in enumerate(names)]
    own = saved(map_arrow(labelled.select("text", "lang", "part", "y"), count, "lang string, word string, cell int, n long").groupBy("lang", "word").agg(*cells), "toxic-words")
    pooled = own.groupBy("word").agg(*(F.sum(c).cast("int").alias(c) for c in names)).select(F.lit("").alias("lang"), "word", *names)
    both = own.filter("lang <> ''").unionByName(pooled)
    total = [sum((F.col(names[p * kinds + k]) for p in range(PARTS)), F.lit(0)) for k in range(kinds)]
    both = both.withColumns({f"t{k}": t for k, t in enumerate(total)})
    # columns, not rows: there may be some hundred thousand features
    array_of = lambda t: np.stack([t.column(c).to_numpy() for c in names], axis=1).reshape(-1, PARTS, kinds).astype(np.int32)
    heads = both.filter("word = ''").toArrow()
    out = {}
    for lang, rows in zip(heads.column("lang").to_pylist(), array_of(heads), strict=True):
        n = rows.sum(axis=0)
        if not 0 < n[-1] < n[0]:
            continue
        odds = lambda k: F.log((F.col(f"t{k}") + 0.5) / F.lit(float(n[k] + 1))) - F.log((F.col("t0") - F.col(f"t{k}") + 0.5) / F.lit(float(n[0] - n[k] + 1)))  # noqa: B023, E731
        leans = F.greatest(*(F.when(F.lit(bool(0 < n[k] < n[0])), odds(k)).otherwise(F.lit(-1.0)) for k in range(1, kinds))) >= least_odds
        found = both.filter((F.col("lang") == lang) & (F.col("word") != "") & (F.col("t0") >= least_docs) & leans).select("word", *names).toArrow()
        out[lang] = Counts(rows, {w: i for i, w in enumerate(found.column("word").to_pylist())}, array_of(found))
    return out


def places_of(counts: dict[str, Counts]) -> dict[str, dict[str, int]]:
    """The rows of leanings(): those of the counts, then the seed words that all languages together lack."""
    out = {lang: c.places for lang, c in counts.items()}
    pooled = dict(out.get("", {}))
    for w in SEED_WORDS:
        pooled.setdefault(w, len(pooled))
    return out | {"": pooled}


def leanings(counts: dict[str, Counts], least_odds: float = 1.0, without: int | None = None) -> dict[str, np.ndarray]:
    """For each category log-odds, and those times the share, by language and row (row, category, 2), over all parts or all but
    one; nothing for a category towards which all parts together do not lean. The share is taken of five documents more, so
    that it says little where few are toxic. Seed words lean by 3 where the labels do not say."""
    out = {}
    for lang, c in counts.items():
        keep = [k for k in range(PARTS) if k != without]
        n, total = c.held[:, keep].sum(axis=1).astype(float), c.rows[keep].sum(axis=0).astype(float)
        every, whole = c.held.sum(axis=1).astype(float), c.rows.sum(axis=0).astype(float)
        out[lang] = np.zeros((len(n), len(CATEGORIES), 2), np.float32)
        for k in range(1, 1 + len(CATEGORIES)):
            odds = log_odds(n[:, k], n[:, 0] - n[:, k], total[k], total[0] - total[k])
            odds[log_odds(every[:, k], every[:, 0] - every[:, k], whole[k], whole[0] - whole[k]) < least_odds] = 0
            out[lang][:, k - 1] = np.stack([odds, odds * n[:, k] / (total[k] + 5)], axis=1)
    pooled = out.get("", np.zeros((0, len(CATEGORIES), 2), np.float32))
    seeds = np.zeros((len(places_of(counts)[""]) - len(pooled), len(CATEGORIES), 2), np.float32)
    seeds[:, -1, 0] = 3
    return out | {"": np.concatenate([pooled, seeds])}


def with_lang(docs: DataFrame) -> DataFrame:
    return docs if "lang" in docs.columns else docs.withColumn("lang", F.lit(""))


def labelled_rows(docs: DataFrame, labels: DataFrame, max_rows: int, least_docs: int, least_odds: float) -> tuple[np.ndarray, np.ndarray, dict[str, Counts]]:
    """The design (row, category, column) and labels (row, category) of the labelled documents, and the counts of features."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("y"))
    chosen = F.broadcast(lowest(known, max_rows, "doc_id"))  # at most max_rows rows of 12 bytes
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(PARTS)).cast("int")
    labelled = saved(with_lang(docs).select("doc_id", "text", "lang").join(chosen, "doc_id").withColumn("part", part), "toxic-labelled")
    counts = count_features(labelled, least_docs, least_odds)
    places = places_of(counts)
    # words of max_rows documents at most; the chains have the same places, so they remember words together
    known: dict[str, dict[str, tuple[int, ...]]] = {}
    chains = docs.sparkSession.sparkContext.broadcast([Chain(places, leanings(counts, least_odds, k), (), known) for k in range(PARTS)])

    def present(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, langs, part = strings(batch.column("text")), strings(batch.column("lang")), batch.column("part").to_numpy()
        x = np.zeros((len(texts), len(CATEGORIES) * WIDTH))
        for k in np.unique(part):
            rows = np.flatnonzero(part == k)
            x[rows] = chains.value[k].design([texts[i] for i in rows], [langs[i] for i in rows]).reshape(len(rows), -1)
        y = [[*seeded(words_of(t)), toxic] for t, toxic in zip(texts, batch.column("y").to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(y, pa.list_(pa.int32())), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    forget = lambda: [c.forget() for c in chains.value]
    made = saved(map_arrow(labelled, present, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y array<int>, x array<double>", forget), "toxic-rows")
    chains.destroy()
    # repeated documents may make more rows than labels: the smallest max_rows are taken
    rows = lowest(made, max_rows, "doc_id", "x").toArrow()
    x, y = (rows.column(c).combine_chunks().flatten().to_numpy() if rows.num_rows else np.zeros(0) for c in ("x", "y"))
    return x.reshape(-1, len(CATEGORIES), WIDTH), y.reshape(-1, len(CATEGORIES)).astype(float), counts


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, least_docs: int = 3, least_odds: float = 1.0, l2: float = 0.1) -> Chain:
    """Fit the chain insult, contempt, toxic."""
    prepare(docs.sparkSession)
    x, y, counts = labelled_rows(docs, labels, max_rows, least_docs, least_odds)
    if len(set(y[:, -1])) < 2:  # nothing to learn from: made-up rows, each seed word against none
        one = np.array([design({w}, {}) for w in SEED_WORDS])
        one[:, :, len(SEED_WORDS) :] = 0
        x = np.concatenate([np.repeat(one, 10, axis=0), np.zeros((10 * len(SEED_WORDS), *one.shape[1:]))])
        y = np.array([[*seeded({w}), 1.0] for w in SEED_WORDS for _ in range(10)] + [[0.0] * len(CATEGORIES)] * (10 * len(SEED_WORDS)))
    return Chain(places_of(counts), leanings(counts, least_odds), fit_chain(x, [(c, y[:, k]) for k, c in enumerate(CATEGORIES)], l2=l2))


def chain_gain(x: np.ndarray, y: np.ndarray, l2: float = 0.1, folds: int = 4) -> dict[str, tuple[float, float]]:
    """Held-out log loss of each category with and without the earlier categories' predictions, by cross-validation."""
    fold = np.arange(len(x)) // 7 % folds
    loss = {c: np.zeros((2, len(x))) for c in CATEGORIES}
    for f in range(folds):
        inside, out = fold != f, fold == f
        fitted = Chain({}, {}, fit_chain(x[inside], [(c, y[inside, k]) for k, c in enumerate(CATEGORIES)], l2=l2))
        p = fitted.predict(x[out])
        for k, c in enumerate(CATEGORIES):
            w = fit_logistic(x[inside, k], y[inside, k], l2)
            for row, q in enumerate((p[:, k], logistic(x[out, k] @ w[:-1] + w[-1]))):
                loss[c][row, out] = -np.log(np.clip(np.where(y[out, k] == 1, q, 1 - q), 1e-9, 1))
    return {c: (float(v[0].mean()), float(v[1].mean())) for c, v in loss.items()}


def score(docs: DataFrame, chain: Chain, keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.5) -> DataFrame:
    """The columns `keep` (renamed k0, k1, ... inside, so that any names do), p_<category> for each category, and `toxic`:
    the last one's probability reaches threshold."""
    prepare(docs.sparkSession)
    names = [f"p_{n}" for n in chain.names]
    sent = docs.sparkSession.sparkContext.broadcast(chain)  # as in labelled_rows()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = sent.value.predict(sent.value.design(strings(batch.column("t")), strings(batch.column("l"))))
        kept = [batch.column(f"k{i}") for i in range(len(keep))]
        return pa.RecordBatch.from_arrays([*kept, *(pa.array(p[:, j]) for j in range(p.shape[1])), pa.array(p[:, -1] >= threshold)], names=[*(f"k{i}" for i in range(len(keep))), *names, "toxic"])

    schema = ", ".join([f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)] + [f"{n} double" for n in names] + ["toxic boolean"])
    return map_arrow(with_lang(docs).select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col("text").alias("t"), F.col("lang").alias("l")), run, schema, lambda: sent.value.forget()).toDF(*keep, *names, "toxic")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, p_insult, p_contempt, p_toxic, toxic for every document."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def reject_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that are not toxic, all columns unchanged."""
    columns = tuple(docs.columns)
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")), columns)
    return scored.filter(scored[scored.columns[-1]] == F.lit(False)).select(*(scored[i] for i in range(len(columns))))
