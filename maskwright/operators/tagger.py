"""A trained detector: names, places, organisations and whatever else a labelled corpus marks.

An averaged perceptron over token features and neighbouring tags (B-, I-, O), decoded by Viterbi, trained on every window of the corpus;
it joins in as any Detector. Spark finds the labelled spans once and deals the texts by hash to shards; in each epoch every shard is
decoded and corrected from the same weights, and the weights of the shards are mixed (iterative parameter mixing). Corrections are summed
as whole numbers, so the model does not depend on how the corpus is partitioned. Tagging runs in small Arrow batches over whole texts.
Training and tagging decode GROUP windows at a time.

Bounds: weights have 2^BITS rows, features are hashed to them. Only who gives `max_windows` trains on a sample: so many windows of WINDOW
tokens, half of them (if there are as many) with a span in them.

Defined cases. Null text: no spans. Empty or blank text: none. No labelled span at all: a model that finds nothing. Spans that cross a
window's end: each part is learnt, and found, by itself; windows end at line breaks where there are any. Labelled spans that overlap: the first, then the longest.
Repeated rows: as often; without a key they are in one shard. Very long texts: window by window.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import occurrence_starts
from ..session import ship, small_batches, stored
from .detect import SPANS

TOKEN = re.compile(r"\w+|[^\w\s]")
WINDOW, BITS = 160, 16
MASK = (1 << BITS) - 1
ACTIVE = 14
#: Windows that are cut or tagged at once.
GROUP = 128
#: Characters of text for each shard of the training.
SHARD_CHARS = 8 << 20


def tokens(text: str) -> np.ndarray:
    """(token, 2): start and end."""
    return np.fromiter((x for m in TOKEN.finditer(text) for x in m.span()), np.int64).reshape(-1, 2)


def windows(text: str, places: np.ndarray) -> Iterator[tuple[int, list[list[int]]]]:
    """The first token's number, and places of at most WINDOW tokens, ended by the last line break in their second half, if there is one."""
    lo = 0
    while lo < len(places):
        own = places[lo : lo + WINDOW + 1].tolist()
        hi = min(len(own), WINDOW)
        if hi < len(own):
            for k in range(hi, WINDOW // 2, -1):
                if "\n" in text[own[k - 1][1] : own[k][0]]:
                    hi = k
                    break
        yield lo, own[:hi]
        lo += hi


def words_of(text: str) -> Iterator[tuple[int, list[str]]]:
    """As windows(), with the words in place of their places."""
    words, ends, lo = [], [], 0
    for line in text.split("\n"):
        words += TOKEN.findall(line)
        ends.append(len(words))
    while lo < len(words):
        hi = min(lo + WINDOW, len(words))
        if hi < len(words) and (k := bisect_right(ends, hi)) and ends[k - 1] > lo + WINDOW // 2:
            hi = ends[k - 1]
        yield lo, words[lo:hi]
        lo = hi


class Kinds(dict):
    """Kinds of characters by code point."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = out = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        return out


_kinds = Kinds()


def shape(word: str) -> str:
    """Kinds of characters, runs shortened to two."""
    return re.sub(r"(.)\1{2,}", r"\1\1", word[:24].translate(_kinds))


def hashed(name: str) -> int:
    return zlib.crc32(name.encode()) & MASK


#: For the hashes of words: the letter before them, and what changes from w to another letter by the length in bytes.
LONG = 256
_P = {x: zlib.crc32(x.encode()) for x in "wpe"}
_TO = {x: np.array([zlib.crc32(bytes(k), zlib.crc32(x.encode())) ^ zlib.crc32(bytes(k), _P["w"]) for k in range(LONG + 1)], np.int64) & MASK for x in "<>23"}
_N = np.array([hashed(f"n{k}") for k in range(21)])


def word_rows(parts: np.ndarray, forms: np.ndarray, longs: np.ndarray) -> np.ndarray:
    """(word, 11) features of words by their parts (shape's number, hash, bytes, hashes of the beginning and end, length) and the hashes of
    shapes. CRC is affine: what another letter before the word changes follows from the length; longs has these hashes for words
    of LONG bytes and more."""
    own, w, size = forms[parts[:, 0]].astype(np.int64), parts[:, 1].astype(np.int64), parts[:, 2]
    out = np.stack([w, own[:, 0], parts[:, 3], parts[:, 4], _N[parts[:, 5]], w ^ _TO["<"][size], w ^ _TO[">"][size], own[:, 1], own[:, 2], w ^ _TO["2"][size], w ^ _TO["3"][size]], axis=1)
    out[longs[:, :1], [5, 6, 9, 10]] = longs[:, 1:]
    return out


class Known(dict):
    """Numbers of words; one that is missing is added to the tables."""

    def __init__(self, tables: Hashes) -> None:
        self.tables = tables

    def __missing__(self, word: str) -> int:
        return self.tables.word(word)


class Hashes:
    """Hashed features of the words and pairs of shapes that were seen, as tables; they are begun anew when they have MOST
    rows or their words MOST_CHARS characters."""

    MOST, MOST_CHARS = 1 << 16, 1 << 21

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.words = Known(self)
        self.pairs: dict[tuple[str, str], int] = {}
        self.chars = 0
        self.new: list[tuple[int, ...]] = []
        self.long: dict[int, list[int]] = {}
        self.form_at: dict[str, int] = {}
        self.raw_at: dict[str, int] = {}
        self.of_form: list[list[int]] = []
        self.parts, self.of_pair = np.zeros((1024, 6), np.int32), np.zeros((1024, 2), np.int32)

    def word(self, word: str) -> int:
        w, raw, at = word.lower(), word[:24].translate(_kinds), len(self.words)
        if (form := self.raw_at.get(raw)) is None:
            form = self.raw_at[raw] = self.form_at.setdefault(shape(word), len(self.form_at))
        long, own = len(w), w.encode()
        self.new.append((form, zlib.crc32(own, _P["w"]) & MASK, len(own) if len(own) < LONG else LONG, zlib.crc32(w[:3].encode(), _P["p"]) & MASK, zlib.crc32(w[-3:].encode(), _P["e"]) & MASK, long if long < 20 else 20))
        if len(own) >= LONG:
            self.long[at] = [hashed(x + w) for x in "<>23"]
        self.words[word] = at
        self.chars += len(word)
        return at

    def filled(self) -> Hashes:
        """Enters the words that came since into the tables."""
        if self.new:
            for name in list(self.form_at)[len(self.of_form) :]:
                self.of_form.append([hashed(f"{x}{name}") for x in "sab"])
            while len(self.parts) < len(self.words):
                self.parts = np.concatenate([self.parts, np.zeros_like(self.parts)])
            self.parts[len(self.words) - len(self.new) : len(self.words)] = self.new
            self.new.clear()
        return self

    def longs(self, at: np.ndarray) -> np.ndarray:
        """(number in at, four hashes) of the long words."""
        return np.array([(k, *self.long[at[k]]) for k in np.flatnonzero(self.parts[at, 2] == LONG)], np.int64).reshape(-1, 5)

    def pair(self, pair: tuple[str, str]) -> int:
        at = len(self.pairs)
        if at == len(self.of_pair):
            self.of_pair = np.concatenate([self.of_pair, np.zeros_like(self.of_pair)])
        self.of_pair[at] = [hashed(f"{x}{pair[0]}{pair[1]}") for x in "cd"]
        self.pairs[pair] = at
        return at

    def fresh(self) -> None:
        """To be called before the first window of a group, as numbers of words hold up to here."""
        if max(len(self.words), len(self.pairs)) > self.MOST or self.chars > self.MOST_CHARS:
            self.clear()

    def ids(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))

    def rows(self, words: list[str]) -> np.ndarray:
        self.fresh()
        known, paired = self.words, self.pairs
        # what is beyond the ends counts as the word ^
        at = np.array([known[w] for w in ("^", "^", *words, "^", "^")])
        names = list(self.filled().form_at)
        forms = [names[k] for k in self.parts[at[1:-1], 0]]
        both = [paired[x] if x in paired else self.pair(x) for x in zip(forms, forms[1:])]
        n, w, p = len(words), word_rows(self.parts[at], np.array(self.of_form), self.longs(at)), self.of_pair[both]
        out = np.empty((n, ACTIVE), np.int64)
        out[:, :5] = w[2 : n + 2, :5]
        out[:, 5], out[:, 6] = w[1 : n + 1, 5], w[3 : n + 3, 6]
        out[:, 7], out[:, 8] = w[1 : n + 1, 7], w[3 : n + 3, 8]
        out[:, 9], out[:, 10] = w[:n, 9], w[4:, 10]
        out[:, 11], out[:, 12] = p[:n, 0], p[1:, 1]
        out[:, 13] = hashed("1")
        return out


_hashes = Hashes()


def features(words: list[str]) -> np.ndarray:
    """(token, ACTIVE) rows of the weights: the word, its shape, ends and length, two neighbours on each side, shapes in pairs."""
    return _hashes.rows(words)


class Group:
    """Windows as one, with two ^ on each side of each: the words and pairs of shapes that occur, their numbers place by place, and
    their features. As bytes it takes about as much as the text."""

    FIELDS = (("sizes", np.int16, 1), ("word", np.uint16, 1), ("parts", np.uint16, 6), ("forms", np.uint16, 3), ("longs", np.int32, 5), ("pair", np.uint16, 1), ("pairs", np.uint16, 2))

    def __init__(self, **fields: np.ndarray) -> None:
        self.fields = fields
        self.sizes, self.word, self.pair = (fields[x].astype(np.int64) for x in ("sizes", "word", "pair"))
        self.words, self.pairs = word_rows(fields["parts"], fields["forms"], fields["longs"]), fields["pairs"].astype(np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.at = np.arange(self.sizes.sum()) + np.repeat(4 * np.arange(len(self.sizes)) + 2, self.sizes)

    @classmethod
    def of(cls, each: Sequence[np.ndarray], tables: Hashes = _hashes) -> Group:
        """From the numbers of the words of each window; GROUP windows at most."""
        end = np.full(2, tables.words["^"])
        seen, word = np.unique(np.concatenate([x for ids in each for x in (end, ids, end)]), return_inverse=True)
        parts = tables.filled().parts[seen]
        names, paired = list(tables.form_at), tables.pairs
        forms = parts[word, 0].astype(np.int64)
        both, pair = np.unique((forms[:-1] << 32) | forms[1:], return_inverse=True)
        at = [paired[x] if x in paired else tables.pair(x) for x in ((names[k >> 32], names[k & 0xFFFFFFFF]) for k in both.tolist())]
        of_form, parts[:, 0] = np.unique(parts[:, 0], return_inverse=True)
        return cls(sizes=np.array([len(x) for x in each]), word=word, parts=parts, forms=np.array(tables.of_form)[of_form], longs=tables.longs(seen), pair=pair, pairs=tables.of_pair[at])

    def packed(self) -> dict[str, bytes]:
        return {name: self.fields[name].astype(kind).tobytes() for name, kind, _ in self.FIELDS}

    @classmethod
    def unpacked(cls, row: dict[str, bytes]) -> Group:
        read = lambda name, kind, k: np.frombuffer(row[name], kind).reshape(-1, k) if k > 1 else np.frombuffer(row[name], kind)
        return cls(**{name: read(name, kind, k) for name, kind, k in cls.FIELDS})

    def rows(self, k: int) -> np.ndarray:
        """features() of a window."""
        at, w, p = self.at[self.begin[k] : self.begin[k] + self.sizes[k]], self.word, self.pair
        out = np.empty((len(at), ACTIVE), np.int64)
        out[:, :5] = self.words[w[at], :5]
        for j, by in ((5, -1), (6, 1), (7, -1), (8, 1), (9, -2), (10, 2)):
            out[:, j] = self.words[w[at + by], j]
        out[:, 11], out[:, 12] = self.pairs[p[at - 1], 0], self.pairs[p[at], 1]
        out[:, 13] = hashed("1")
        return out

    def emit(self, weights: np.ndarray) -> np.ndarray:
        """The sum of the weights of each token's features; those of a word or pair are summed once."""
        of, at, w, p = np.ascontiguousarray(self.words.T), self.at, self.word, self.pair

        def summed(*features: np.ndarray) -> np.ndarray:
            out = weights.take(features[0], axis=0)
            for x in features[1:]:
                out += weights.take(x, axis=0)
            return out

        out = (summed(*of[:5]) + weights[hashed("1")]).take(w[at], axis=0)
        for features, place in (((of[5], of[7]), w[at - 1]), ((of[6], of[8]), w[at + 1]), ((of[9],), w[at - 2]), ((of[10],), w[at + 2]), ((self.pairs[:, 0],), p[at - 1]), ((self.pairs[:, 1],), p[at])):
            out += summed(*features).take(place, axis=0)
        return out


@dataclass(frozen=True)
class Model:
    tags: tuple[str, ...]
    weights: np.ndarray  # (feature, tag)
    moves: np.ndarray  # (tag before, tag); the last row is the beginning

    def decode(self, rows: np.ndarray) -> list[int]:
        """The best sequence of tags. I-x comes after B-x or I-x only."""
        emit = self.weights[rows].sum(axis=1)
        n = len(self.tags)
        best, came = emit[0] + self.moves[n], np.zeros(emit.shape, np.int64)
        for i in range(1, len(emit)):
            all_ways = best[:, None] + self.moves[:n]
            came[i] = all_ways.argmax(axis=0)
            best = all_ways[came[i], np.arange(n)] + emit[i]
        out = [int(best.argmax())]
        for i in range(len(emit) - 1, 0, -1):
            out.append(int(came[i][out[-1]]))
        return out[::-1]

    def decode_all(self, each: Sequence[np.ndarray]) -> list[list[int]]:
        """decode() of every window."""
        sizes = np.array([len(rows) for rows in each])
        emit = self.weights[np.concatenate(each)].sum(axis=1) if len(each) else np.zeros((0, len(self.tags)))
        return [x.tolist() for x in np.split(self.best(emit, sizes), np.cumsum(sizes)[:-1])]

    def outside(self, emit: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Per token: is O certain? No tag wins more against O than by its emission, the best move to it and, for B-x, the best move back to
        O. Spans whose tokens win less than nothing in sum are not on the best path; certain is a token that all such sums leave out."""
        n, o, wide = len(self.tags), self.tags.index("O"), int(sizes.max())
        gain = np.maximum(self.moves[:n].max(axis=0) - self.moves[o, o], self.moves[n] - self.moves[n, o])
        gain[[t[:2] == "B-" for t in self.tags]] += self.moves[:n, o].max() - self.moves[o, o]
        gain[o] = -np.inf
        won, inside = np.full((len(sizes), wide), -1.0), np.arange(wide) < sizes[:, None]
        won[inside] = (emit + gain).max(axis=1) - emit[:, o] if n > 1 else -1.0
        upto = np.cumsum(won, axis=1)
        most = np.maximum.accumulate(upto[:, ::-1], axis=1)[:, ::-1]
        least = np.minimum.accumulate(upto - won, axis=1)
        return (most - least < -1e-6)[inside]

    def best(self, emit: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The best tags of all tokens of windows (of the given sizes, none empty). What lies between tokens that are certainly O is decoded."""
        out = np.full(len(emit), self.tags.index("O") if "O" in self.tags else 0)
        if not len(emit):
            return out
        n, first = len(self.tags), np.cumsum(sizes) - sizes
        open_ = ~self.outside(emit, sizes) if "O" in self.tags else np.ones(len(emit), bool)
        if not open_.any():
            return out
        opens = np.zeros(len(emit) + 1, bool)
        opens[first] = opens[-1] = True  # where windows begin, and the end
        begin = np.flatnonzero(open_ & (opens[:-1] | ~np.append(False, open_[:-1])))
        end = np.flatnonzero(open_ & (opens[1:] | ~np.append(open_[1:], False))) + 1
        came = np.where(opens[begin][:, None], self.moves[n], self.moves[out[begin]])
        left = np.where(opens[end][:, None], 0.0, self.moves[:n][:, out[0]])
        out[open_] = self.viterbi(emit[open_], end - begin, came, left)
        return out

    def viterbi(self, emit: np.ndarray, sizes: np.ndarray, came_by: np.ndarray, left_by: np.ndarray) -> np.ndarray:
        """A step of all pieces at once, with the moves to their first tags and from their last; the longest pieces first, so that
        those not yet at their end are the first ones."""
        order = np.argsort(-sizes, kind="stable")
        n, begin = len(self.tags), (np.cumsum(sizes) - sizes)[order]
        going = [int(np.count_nonzero(sizes > i)) for i in range(sizes.max(initial=0))]
        best, came, out = emit[begin] + came_by[order], np.zeros(emit.shape, np.int64), np.zeros(len(emit), np.int64)
        for i, k in enumerate(going[1:], 1):
            all_ways = best[:k, :, None] + self.moves[:n]
            way = all_ways.argmax(axis=1)
            came[begin[:k] + i] = way
            best[:k] = np.take_along_axis(all_ways, way[:, None], 1)[:, 0] + emit[begin[:k] + i]
        tag = (best + left_by[order]).argmax(axis=1)
        for i in range(len(going) - 1, -1, -1):
            k = going[i]
            out[begin[:k] + i] = tag[:k]
            tag[:k] = came[begin[:k] + i, tag[:k]]
        return out


def barred(tags: Sequence[str]) -> np.ndarray:
    """What moves may never be: -inf where I-x does not follow B-x or I-x."""
    out = np.zeros((len(tags) + 1, len(tags)))
    for j, t in enumerate(tags):
        if t.startswith("I-"):
            for i, before in enumerate((*tags, "^")):
                if before[2:] != t[2:] or before == "O":
                    out[i, j] = -np.inf
    return out


def fit(samples: list[tuple[list[str], list[str]]], epochs: int = 6, seed: int = 3) -> Model:
    """samples: words and their tags."""
    tags = tuple(sorted({t for _, ts in samples for t in ts} | {"O"}))
    tags = tuple(sorted({*tags, *(f"I-{t[2:]}" for t in tags if t[:2] == "B-"), *(f"B-{t[2:]}" for t in tags if t[:2] == "I-")}))
    number = {t: k for k, t in enumerate(tags)}
    w, wa = (np.zeros((1 << BITS, len(tags))) for _ in range(2))
    m, ma = (np.zeros((len(tags) + 1, len(tags))) for _ in range(2))
    bar, rng, step = barred(tags), np.random.default_rng(seed), 1
    made = [(features(words), np.array([number[t] for t in ts])) for words, ts in samples if words]
    for _ in range(epochs):
        wrong = 0
        for k in rng.permutation(len(made)):
            rows, gold = made[k]
            said = np.array(Model(tags, w, m + bar).decode(rows))
            for i in np.flatnonzero(said != gold):
                wrong += 1
                for x, sign in ((gold[i], 1.0), (said[i], -1.0)):
                    np.add.at(w, (rows[i], x), sign)
                    np.add.at(wa, (rows[i], x), sign * step)
            for x, sign in ((gold, 1.0), (said, -1.0)):
                before = np.append(len(tags), x[:-1])
                np.add.at(m, (before, x), sign)
                np.add.at(ma, (before, x), sign * step)
            step += 1
        if not wrong:
            break
    return Model(tags, (w - wa / step).astype(np.float32), m - ma / step + bar)


def spans_of_all(texts: Iterable[str], model: Model) -> list[list[tuple[str, int, int]]]:
    """Spans of each text; GROUP windows are decoded at once, whichever texts they are of."""
    out: list[list] = []
    held: list[tuple[str, list, int, np.ndarray]] = []
    outside = model.tags.index("O") if "O" in model.tags else -1

    def flush() -> None:
        group, last, places = Group.of([ids for *_, ids in held]), None, None
        said = model.best(group.emit(model.weights), group.sizes)
        for (text, spans, lo, ids), at in zip(held, group.begin, strict=True):
            own = said[at : at + len(ids)]
            for k in np.flatnonzero(own != outside).tolist():
                if spans is not last:  # its first span in this group
                    last, places = spans, tokens(text)
                t, (a, b) = model.tags[own[k]], places[lo + k].tolist()
                if t[:2] == "B-":
                    spans.append([t[2:], a, b])
                else:
                    spans[-1][2] = b
        held.clear()

    for text in texts:
        out.append([])
        for lo, words in words_of(text):
            if not held:
                _hashes.fresh()
            held.append((text, out[-1], lo, _hashes.ids(words)))
            if len(held) >= GROUP:
                flush()
    if held:
        flush()
    return [[tuple(s) for s in spans] for spans in out]


def spans_of(text: str, model: Model) -> list[tuple[str, int, int]]:
    return spans_of_all([text], model)[0]


def tagged(text: str, spans: list[dict]) -> Iterator[tuple[list[str], list[str]]]:
    """Words and tags of each window. A span covers the tokens that it holds as a whole or in part."""
    places = tokens(text)
    tags, last = ["O"] * len(places), 0
    starts = places[:, 0]
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] < last:
            continue
        k = int(np.searchsorted(starts, s["start"], side="right")) - 1
        k += k < 0 or places[k][1] <= s["start"]
        first = k
        while k < len(places) and places[k][0] < s["end"]:
            tags[k] = f"{'B' if k == first else 'I'}-{s['type']}"
            k += 1
        last = s["end"]
    for lo, part in windows(text, places):
        own = tags[lo : lo + len(part)]
        yield [text[a:b] for a, b in part], [f"B-{own[0][2:]}" if own[0][:2] == "I-" else own[0], *own[1:]]


def labelled(text: Column, expected: Column) -> Column:
    """array<struct<type, start, end>>: where the literals of a map<pii, type> stand in text."""
    entry = lambda e: F.transform(occurrence_starts(text, e["key"]), lambda s: F.struct(e["value"].alias("type"), s.cast("int").alias("start"), (s + F.length(e["key"])).cast("int").alias("end")))
    return F.when(text.isNotNull() & expected.isNotNull(), F.flatten(F.transform(F.map_entries(expected), entry))).otherwise(F.array().cast("array<struct<type:string,start:int,end:int>>"))


def bare_spans() -> Column:
    return F.transform("spans", lambda s: F.struct(s["type"].alias("type"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans")


def packed(rows: Iterator[tuple[int, str, list[dict]]]) -> Iterator[dict]:
    """Groups of the windows of (shard, text, spans), each of one shard, as bytes, with the places and tags of tokens that are not O."""
    held: list[tuple[np.ndarray, Sequence[str]]] = []
    at = None

    def made() -> dict:
        gold = [t for _, own in held for t in own]
        places = [k for k, t in enumerate(gold) if t != "O"]
        row = {"shard": at, "places": np.array(places, np.int32).tobytes(), "tags": [gold[k] for k in places]} | Group.of([ids for ids, _ in held]).packed()
        held.clear()
        return row

    for shard, text, spans in rows:
        if shard != at and held:
            yield made()
        at = shard
        for words, own in tagged(text, spans) if spans else ((words, ("O",) * len(words)) for _, words in words_of(text)):
            if not held:
                _hashes.fresh()
            held.append((_hashes.ids(words), own))
            if len(held) >= GROUP:
                yield made()
    if held:
        yield made()


class Shard:
    """One epoch over the windows of a shard, from weights (feature, tag; then the moves) that all shards begin with. A window that
    is wrong by the weights its group began with is decoded and corrected by those of its turn."""

    def __init__(self, tags: Sequence[str], weights: np.ndarray) -> None:
        self.tags, self.weights, self.bar = tags, weights.copy(), barred(tags)
        #: Corrections of each cell, and these times their steps.
        self.change, self.late = (np.zeros(weights.size, np.int64) for _ in range(2))
        self.step = self.wrong = 0

    def model(self) -> Model:
        return Model(self.tags, self.weights, self.weights[1 << BITS :] + self.bar)

    def add(self, group: Group, gold: np.ndarray) -> None:
        off = self.model().best(group.emit(self.weights), group.sizes) != gold
        golds = np.split(gold, group.begin[1:])
        for k in np.flatnonzero(np.logical_or.reduceat(off, group.begin)).tolist():
            rows, gold = group.rows(k), golds[k]
            said = np.array(self.model().decode(rows))
            bad = np.flatnonzero(said != gold)
            self.wrong += len(bad)
            for x, sign in ((gold, 1), (said, -1)) if len(bad) else ():
                before = np.append(len(self.tags), x[:-1])
                cells = np.append((rows[bad] * len(self.tags) + x[bad, None]).ravel(), ((1 << BITS) + before) * len(self.tags) + x)
                np.add.at(self.weights.reshape(-1), cells, sign)
                np.add.at(self.change, cells, sign)
                np.add.at(self.late, cells, sign * (self.step + k + 1))
        self.step += len(group.sizes)

    def result(self) -> pa.RecordBatch:
        """Per cell: its change, and the sum of its changes after each step; at -1, the steps and wrong tokens; at -2, one shard."""
        total = (self.step + 1) * self.change - self.late
        at = np.flatnonzero((self.change != 0) | (total != 0))
        return pa.RecordBatch.from_pydict({"cell": np.append(at, (-1, -2)), "change": np.append(self.change[at], (self.step, 1)), "total": np.append(total[at], (self.wrong, 0))})


def learn(docs: DataFrame, epochs: int = 6, key: Column | None = None) -> Model:
    """train() on every window."""
    spark = docs.sparkSession
    rows = docs.filter("text is not null").withColumn("h", F.xxhash64("text" if key is None else key))
    shards = (rows.agg(F.sum(F.length("text"))).first()[0] or 0) // SHARD_CHARS + 1
    rows = rows.select("text", bare_spans(), "h", F.pmod("h", F.lit(shards)).cast("int").alias("shard"))
    dealt = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "h", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("shard", "text", "spans")), strict=True))
        for row in packed(rows):
            yield pa.RecordBatch.from_pylist([row], schema)

    names = (*(name for name, *_ in Group.FIELDS), "places")
    schema = pa.schema([("shard", pa.int32()), *((name, pa.binary()) for name in names), ("tags", pa.list_(pa.string()))])
    # hashed once for all epochs
    groups = dealt.mapInArrow(pack, f"shard int, {', '.join(f'{name} binary' for name in names)}, tags array<string>").persist(StorageLevel.DISK_ONLY)

    def epoch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, number = None, None, {t: k for k, t in enumerate(tags)}
        for b in batches:
            for k in range(b.num_rows):
                row = {name: b.column(name)[k].as_py() for name in schema.names}
                if row["shard"] != at:
                    if own:
                        yield own.result()
                    at, own = row["shard"], Shard(tags, sent.value)
                group = Group.unpacked(row)
                gold = np.full(len(group.at), number["O"])
                gold[np.frombuffer(row["places"], np.int32)] = [number[t] for t in row["tags"]]
                own.add(group, gold)
        if own:
            yield own.result()

    try:
        kinds = sorted({r[0][2:] for r in groups.select(F.explode("tags")).distinct().collect()})
        tags = tuple(sorted(("O", *(f"{x}-{k}" for k in kinds for x in "BI"))))
        weights = np.zeros(((1 << BITS) + len(tags) + 1, len(tags)))
        total, steps = np.zeros_like(weights), 0
        for _ in range(epochs if kinds else 0):
            sent = spark.sparkContext.broadcast(weights)
            each = groups.mapInArrow(epoch, "cell long, change long, total long").groupBy("cell").agg(F.sum("change").alias("change"), F.sum("total").alias("total"))
            got = each.toArrow()  # a row for each weight at most
            sent.destroy()
            cell, change, late = (got.column(c).to_numpy() for c in ("cell", "change", "total"))
            sums = {int(c): (int(x), int(y)) for c, x, y in zip(cell[cell < 0], change[cell < 0], late[cell < 0])}
            (n, wrong), told = sums.get(-1, (0, 0)), cell >= 0
            total += n * weights
            total.reshape(-1)[cell[told]] += late[told]
            steps += n
            weights.reshape(-1)[cell[told]] += change[told] / max(sums.get(-2, (1, 0))[0], 1)
            if not wrong:
                break
    finally:
        groups.unpersist()
    total /= max(steps, 1)
    return Model(tags, total[: 1 << BITS].astype(np.float32), total[1 << BITS :] + barred(tags))


def train(docs: DataFrame, max_windows: int | None = None, epochs: int = 6, key: Column | None = None) -> Model:
    """From text and spans (array of structs with type, start, end): all of them, unless max_windows asks for a sample. A key that
    tells rows apart deals equal ones to different shards."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    if max_windows is None:
        return learn(docs, epochs, key)
    rows = docs.filter("text is not null").select("text", bare_spans())

    def batch(made: list[tuple[list[str], list[str]]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"words": pa.array([w for w, _ in made], pa.list_(pa.string())), "tags": pa.array([t for _, t in made], pa.list_(pa.string()))})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = []
        for b in batches:
            for text, spans in zip(b.column("text"), b.column("spans"), strict=True):
                for window in tagged(text.as_py(), spans.as_py() or []):
                    made.append(window)
                    if len(made) >= GROUP:
                        yield batch(made)
                        made = []
        if made:
            yield batch(made)

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The max_windows windows of the task with the smallest hash, of those with a span and of the others."""
        held, bound = {True: [], False: []}, {True: None, False: None}

        def fewer(some: bool) -> None:
            both = pa.Table.from_batches(held[some])
            both = both.take(pc.sort_indices(both, [("h", "ascending")])[:max_windows]).combine_chunks()
            held[some] = both.to_batches()
            bound[some] = both.column("h")[-1] if len(both) == max_windows else None

        for b in batches:
            for some in (True, False):
                part = b.filter(pc.equal(b.column("some"), some))
                if bound[some] is not None:
                    part = part.filter(pc.less(part.column("h"), bound[some]))
                if part.num_rows:
                    held[some].append(part)
                    if sum(x.num_rows for x in held[some]) >= 2 * max_windows:
                        fewer(some)
        for some in (True, False):
            if held[some]:
                fewer(some)
                yield from held[some]

    ddl = "words array<string>, tags array<string>"
    each = rows.mapInArrow(cut, ddl).withColumn("h", F.xxhash64("words")).withColumn("some", F.exists("tags", lambda t: t != "O"))
    low = stored(each.mapInArrow(lowest, f"{ddl}, h long, some boolean"), "windows")  # both groups from one pass

    def first(some: Column, n: int) -> list:
        last = low.filter(some).select("h").orderBy("h").limit(n).agg(F.max("h")).first()[0]
        return low.filter(some & (F.col("h") <= last)).orderBy("h").limit(n).collect() if last is not None else []

    taken = first(F.col("some"), max_windows)
    plain = first(~F.col("some"), max(max_windows - len(taken), min(len(taken), max_windows // 2), 1))
    if len(taken) + len(plain) > max_windows:
        taken = taken[: max_windows - len(plain)]
    return fit([(list(r.words), list(r.tags)) for r in [*taken, *plain]], epochs)


class Tagger:
    """A Detector; its Column holds a Python function, so it cannot stand inside a lambda."""

    def __init__(self, model: Model, name: str = "tagger", score: float = 0.7) -> None:
        self.name, self.model, self.score = name, model, score

    def spans(self, text: Column, lang: Column | None = None) -> Column:
        import pandas as pd

        model, name, score = self.model, self.name, self.score
        if (spark := SparkSession.getActiveSession()) is not None:
            small_batches(spark)

        def run(texts):
            texts = texts.fillna("").tolist()
            return pd.Series([[{"type": k, "text": t[a:b], "start": a, "end": b, "score": score, "source": name} for k, a, b in spans] for t, spans in zip(texts, spans_of_all(texts, model), strict=True)])

        run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
        return F.pandas_udf(run, SPANS)(text)


def span_scores(found: DataFrame) -> DataFrame:
    """type, tp, fp, fn per row of spans (found) and gold (both arrays with type, start, end): exact ends and types."""
    bare = lambda c: F.array_distinct(F.transform(c, lambda s: F.concat_ws(" ", s["type"], s["start"].cast("string"), s["end"].cast("string"))))
    both = found.select(bare("spans").alias("s"), bare("gold").alias("g"))
    told = lambda name, kept: F.transform(kept, lambda x: F.struct(F.substring_index(x, " ", 1).alias("type"), F.lit(name).alias("what")))
    each = both.select(F.explode(F.concat(told("tp", F.array_intersect("s", "g")), told("fp", F.array_except("s", "g")), told("fn", F.array_except("g", "s")))).alias("x")).select("x.*")
    return each.groupBy("type").agg(*(F.count_if(F.col("what") == n).alias(n) for n in ("tp", "fp", "fn")))
