"""SentencePiece encoding and decoding with a weighted finite-state transducer.

Compiled from a model file (its protobuf is read here; nothing is trained), as arc tables with weights:
  N  the normaliser: characters to normalised characters. The model's own rewriting rules are arcs of a byte automaton
     (the longest match wins); the blank symbol stands for each space, and before the text if the model says so;
  P  the pieces: a prefix tree. Arcs read a character, and an arc into a place where a piece ends may go back to the root,
     emitting the piece's id, for the piece's weight: minus its score in a unigram model, 0 in a merge model;
  B  byte fallback: an arc for a character that is no piece, emitting its UTF-8 bytes' ids, for the weight of an unknown;
  C  in a merge model, the acceptor over ids: an arc for piece q after piece p weighs 0 if encoding their joined text gives just
     p, q, and infinity otherwise. A unigram model has no C.
An input is composed with N, and what comes out with (P or B)* and C. The composition is never built: its states are (place in
the input, node of P, last piece), made as they are reached. The tropical shortest path (weights are added along a path, the
least wins, the first of equals) is found by relaxing the arcs forward over the places, in single precision as the
reference format has it, for many parts of texts at a time: a step of relaxation is one array operation for all of them.
Sums begin anew in each part, so that unigram scores which agree to seven digits may be ranked otherwise than over a whole text.

Why the shortest path is what byte-pair merging gives: merges go by piece rank, ties from the left. Merges inside one piece
do not touch another, so the first merge across the border of two neighbouring pieces happens in the whole text if and
only if it happens in the text of these two. Hence a sequence of pieces is the encoding if and only if all neighbours are
compatible; every prefix of a text has exactly one such sequence, so one last piece for each place is all that C needs.

No piece holds the blank symbol after another character, and none holds a character that is no piece by itself (both are
checked when compiling); so every path passes between a character and a following blank, and, in long parts, around
characters that are no pieces and between two characters that no piece holds next to each other. What is between two such
places is a part. Equal parts are composed once and remembered in a bounded memory.

Defined cases. Null text: as empty, no ids. Empty text: no ids, decodes to empty. A blank symbol in the text itself is a
space, as in the reference format. Very long texts and parts: linear time. Repeated rows: each. Empty tables: empty.
Other columns are ignored. Models of words or characters, with user-defined or unused pieces, or without byte fallback, are
refused with ValueError.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_arrow, prepare, strings, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, MERGES = 1, 2
#: Parts that a worker remembers (twice as many at most), the longest that are relaxed together, cells of such a group, and
#: places (a power of two) for the weights of pairs.
REMEMBERED, LONGEST, CELLS, PAIRS = 150_000, 48, 1 << 18, 1 << 20
#: How far the score of an unknown lies below the lowest one: a fixed value of the format.
PENALTY = 10.0
#: A rank that no merge has.
NEVER = (1 << 31) - 1


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 1:
            at += 8
            yield key >> 3, data[at - 8 : at]
        elif kind == 2:
            n = varint()
            at += n
            yield key >> 3, data[at - n : at]
        elif kind == 5:
            at += 4
            yield key >> 3, struct.unpack("<f", data[at - 4 : at])[0]
        else:
            raise ValueError(f"wire type {kind}")


class Normaliser:
    """N. rules: the model's compiled rewriting rules, an automaton over bytes as a double array, then the outputs."""

    def __init__(self, rules: bytes, prefix: bool, trim: bool) -> None:
        self.prefix, self.trim = prefix, trim
        size = struct.unpack("<I", rules[:4])[0] if rules else 0
        self.units = np.frombuffer(rules[4 : 4 + size], np.uint32).tolist()
        self.outputs = rules[4 + size :]
        self.rewritten: dict[str, bool] = {}

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """End and output of the longest path from `at` that ends in a final state."""
        units, found = self.units, None
        node = (units[0] >> 10) << ((units[0] & 512) >> 6)
        for k in range(at, len(data)):
            node ^= data[k]
            unit = units[node] if node < len(units) else 0
            if unit & 0x800000FF != data[k]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit & 256:
                begin = units[node] & 0x7FFFFFFF
                found = k + 1, self.outputs[begin : self.outputs.index(b"\0", begin)]
        return found

    def rewrite(self, text: str) -> str:
        data, out, at = text.encode("utf-8", "surrogatepass"), [], 0
        while at < len(data):
            found = self.longest(data, at)
            if found is None:
                first = data[at]
                end = at + (1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4)
                out.append(data[at:end])
                at = end
            else:
                at, piece = found
                out.append(piece)
        return b"".join(out).decode("utf-8", "surrogatepass")

    def __call__(self, text: str) -> str:
        """The normalised text, with blank symbols."""
        if self.units:
            text = self.rewrite(text)
        if self.trim:
            text = re.sub(" +", " ", text).lstrip(" ")
        out = (BLANK if self.prefix else "") + text.replace(" ", BLANK) if text else ""
        return out.rstrip(BLANK) if self.trim else out

    @property
    def plain(self) -> bool:
        """Only blanks are rewritten, one by one."""
        return not self.units and not self.trim


class Transducer:
    """The compiled machine. Build it from the bytes of a model file."""

    def __init__(self, model: bytes) -> None:
        self.pieces: list[str] = []
        kinds: list[int] = []
        scores: list[float] = []
        spec: dict = {}
        kind = UNIGRAM
        for number, value in fields(model):
            if number == 1:
                piece = {1: b"", 2: 0.0, 3: NORMAL} | dict(fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(piece[2])
                kinds.append(piece[3])
            elif number == 2:
                trainer = dict(fields(value))
                kind = trainer.get(3, UNIGRAM)
                if trainer.get(24):
                    raise ValueError("blanks at the ends of pieces are not compiled")
            elif number == 3:
                spec = dict(fields(value))
        if kind not in (UNIGRAM, MERGES) or not spec.get(5, 1):
            raise ValueError("only unigram and merge models that escape white space are compiled")
        if any(k in (USER_DEFINED, UNUSED) for k in kinds):
            raise ValueError("user-defined and unused pieces are not compiled")
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == BYTE}
        if len(self.byte) != 256:
            raise ValueError("the model has no byte fallback")
        self.normalise = Normaliser(spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)))
        self.merging = kind == MERGES
        ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == NORMAL}
        order = sorted(ids.values(), key=lambda i: -scores[i])
        self.rank = {self.pieces[i]: r for r, i in enumerate(order)}
        self.single = {p for p in ids if len(p) == 1}
        for p in ids:
            if BLANK in p.lstrip(BLANK) or not self.single.issuperset(p):
                raise ValueError(f"piece {p!r} does not let the path fall apart")
        self.inner = {p[i : i + 2] for p in ids for i in range(len(p) - 1)}
        self.weight = np.zeros(len(self.pieces), np.float32) if self.merging else -np.array(scores, np.float32)
        self.unknown = np.float32(0 if self.merging else PENALTY - min(scores[i] for i in ids.values()))
        self.compile(ids)
        self.raw = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else p.replace(BLANK, " ").encode() for p, k in zip(self.pieces, kinds, strict=True)]
        for i, k in enumerate(kinds):
            if k == UNKNOWN:
                self.raw[i] = " ⁇ ".encode()
        if self.merging:
            self.ids, longest = ids, max(map(len, ids))
            self.traced = np.zeros(len(self.pieces), np.int8)
            self.merges = np.full((len(self.pieces), longest), NEVER, np.int32)
            self.left, self.right = np.zeros((len(self.pieces), longest), np.int32), np.zeros((len(self.pieces), longest), np.int32)
            joins = {ids[p[:i]] * len(self.pieces) + ids[p[i:]]: self.rank[p] for p in ids for i in range(1, len(p)) if p[:i] in ids and p[i:] in ids}
            self.joins = np.array(sorted(joins), np.int64)
            self.joined = np.array([joins[k] for k in self.joins.tolist()], np.int32)
        self.pair, self.fits = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)
        # two generations, so that forgetting what is rare keeps what is frequent
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def compile(self, ids: dict[str, int]) -> None:
        """P: letter numbers the characters from 1 on; arcs maps node * letters + letter to a node, root 0; ends gives the piece
        that ends at a node, or -1."""
        letters = sorted({c for p in ids for c in p})
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.letters = len(letters) + 1
        self.arcs: dict[int, int] = {}
        ends = [-1]
        for p, i in ids.items():
            node = 0
            for c in p:
                key = node * self.letters + int(self.letter[ord(c)])
                node = self.arcs.setdefault(key, len(ends))
                if node == len(ends):
                    ends.append(-1)
            ends[node] = i
        self.ends = np.array(ends, np.int32)
        keys, nexts = np.array(list(self.arcs), np.int64), np.array(list(self.arcs.values()), np.int32)
        self.first = np.full(self.letters, -1, np.int32)
        at = keys < self.letters
        self.first[keys[at]] = nexts[at]
        # a hash table with open addressing, filled for all keys at once: a key that finds its place taken tries the next one
        size = 1 << (4 * len(keys)).bit_length()
        self.keys, self.nexts = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        place = self.place(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[place] < 0)
            free = free[np.unique(place[free], return_index=True)[1]]
            self.keys[place[free]], self.nexts[place[free]] = keys[free], nexts[free]
            left = self.keys[place] != keys
            keys, nexts, place = keys[left], nexts[left], (place[left] + 1) & (size - 1)

    def place(self, key: np.ndarray) -> np.ndarray:
        return (key * 0x9E3779B97F4A7 >> 20) & (len(self.keys) - 1)

    def step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """P's arcs: the next nodes, -1 for none."""
        key = node.astype(np.int64) * self.letters + letter
        at = self.place(key)
        found = self.keys[at]
        out = np.where(found == key, self.nexts[at], -1)
        rows = np.flatnonzero((found != key) & (found >= 0))
        while len(rows):
            at[rows] = (at[rows] + 1) & (len(self.keys) - 1)
            found = self.keys[at[rows]]
            hit = found == key[rows]
            out[rows[hit]] = self.nexts[at[rows[hit]]]
            rows = rows[~hit & (found >= 0)]
        return out

    def trace(self, piece: int) -> None:
        """How merging by rank builds a piece from its characters: the rank of each merge in turn, and the pieces at its left and
        right edge before each and at the end. A piece that is not built is marked so."""
        parts, get, none = list(self.pieces[piece]), self.rank.get, NEVER
        ranks = [get(a + b, none) for a, b in zip(parts, parts[1:])]  # noqa: B905
        n = 0
        while True:
            self.left[piece, n], self.right[piece, n] = self.ids[parts[0]], self.ids[parts[-1]]
            if not ranks or (best := min(ranks)) == none:
                break
            self.merges[piece, n] = best
            at, n = ranks.index(best), n + 1
            word = parts[at] + parts[at + 1]
            parts[at : at + 2] = [word]
            del ranks[at]
            if at:
                ranks[at - 1] = get(parts[at - 1] + word, none)
            if at < len(ranks):
                ranks[at] = get(word + parts[at + 1], none)
        self.traced[piece] = 1 if len(parts) == 1 else 2

    def unmerged(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Does merging the joined text of p and q by rank leave p and q? Until a merge crosses the border, each side is built as
        it is alone, and the lowest rank of either side is next. So both are followed step by step; a merge across comes
        first if its rank is below the left side's next, and not above the right side's (equal ranks go from the left)."""
        for piece in np.unique(np.concatenate([p, q])):
            if not self.traced[piece]:
                self.trace(piece)
        out = (self.traced[p] == 1) & (self.traced[q] == 1)
        rows = np.flatnonzero(out)
        i, k = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
        while len(rows):
            a, b = p[rows], q[rows]
            before, behind = self.merges[a, i[rows]], self.merges[b, k[rows]]
            key = self.right[a, i[rows]].astype(np.int64) * len(self.pieces) + self.left[b, k[rows]]
            at = np.minimum(np.searchsorted(self.joins, key), len(self.joins) - 1)
            across = np.where(self.joins[at] == key, self.joined[at], NEVER)
            crossed = (across < before) & (across <= behind) & (across < NEVER)
            out[rows[crossed]] = False
            going = ~crossed & ((before < NEVER) | (behind < NEVER))
            left = before <= behind
            i[rows[going & left]] += 1
            k[rows[going & ~left]] += 1
            rows = rows[going]
        return out

    def compatible(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """C's finite arcs: may q follow p? p = -1: may q be first? Answers are kept, each pair in a place of its own."""
        pair = (p.astype(np.int64) + 1) * len(self.pieces) + q
        place = (pair * 0x9E3779B1 >> 7) & (len(self.pair) - 1)
        out = self.fits[place]
        lost = np.flatnonzero(self.pair[place] != pair)
        if len(lost):
            new, back = np.unique(pair[lost], return_inverse=True)
            a, b = new // len(self.pieces) - 1, new % len(self.pieces)
            out[lost] = self.first_or_next(a, b)[back]
            self.pair[place[lost]], self.fits[place[lost]] = pair[lost], out[lost]
        return out

    def first_or_next(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), bool)
        first = a < 0
        for k in np.flatnonzero(first):
            if not self.traced[b[k]]:
                self.trace(b[k])
        out[first] = self.traced[b[first]] == 1
        out[~first] = self.unmerged(a[~first], b[~first])
        return out

    def relax(self, parts: list[str]) -> list[tuple[int, ...]]:
        """Shortest paths of parts of at most LONGEST characters, all together."""
        size = np.array([len(p) for p in parts])
        width = int(size.max())
        codes = self.letter[np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        inside = np.arange(width)[:, None] < size
        letters = np.zeros((width, len(parts)), np.int32)
        letters.T[inside.T] = codes
        dist = np.full((width + 1, len(parts)), np.inf, np.float32)
        last = np.full((width + 1, len(parts)), -1, np.int32)  # -1: none, or bytes
        back = np.zeros((width + 1, len(parts)), np.int32)
        dist[0] = 0
        for j in range(width):
            rows = np.flatnonzero(inside[j] & np.isfinite(dist[j]))
            live, node, k = rows, self.first[letters[j, rows]], j
            some = np.zeros(len(parts), bool)  # a piece of this one character
            while True:
                ok = node >= 0
                live, node, k = live[ok], node[ok], k + 1
                if not len(live):
                    break
                piece = self.ends[node]
                hit = piece >= 0
                r, q = live[hit], piece[hit]
                if k == j + 1:
                    some[r] = True
                if len(r):
                    total = dist[j, r] + self.weight[q]
                    better = np.flatnonzero(total < dist[k, r])
                    if self.merging:
                        better = better[self.compatible(last[j, r[better]], q[better])]
                    r, q = r[better], q[better]
                    dist[k, r], last[k, r], back[k, r] = total[better], q, j
                if k >= width:
                    break
                node = self.step(node, letters[k, live])
            r = rows[~some[rows]]  # B
            total = dist[j, r] + self.unknown
            r, total = r[total < dist[j + 1, r]], total[total < dist[j + 1, r]]
            dist[j + 1, r], last[j + 1, r], back[j + 1, r] = total, -1, j
        return self.paths(parts, size, last, back)

    def paths(self, parts: list[str], size: np.ndarray, last: np.ndarray, back: np.ndarray) -> list[tuple[int, ...]]:
        """The ids along the shortest paths, gone back from the ends all together."""
        rows, at, steps = np.arange(len(parts)), size.copy(), []
        count = np.zeros(len(parts), np.int64)
        while len(rows):
            steps.append((rows, last[at, rows], at))
            count[rows] += 1
            at = back[at, rows]
            going = at > 0
            rows, at = rows[going], at[going]
        ends = np.cumsum(count)
        q, place = np.empty(ends[-1], np.int32), np.empty(ends[-1], np.int32)
        for k, (rows, piece, at) in enumerate(steps):  # the k-th from the end
            q[ends[rows] - 1 - k], place[ends[rows] - 1 - k] = piece, at
        row = np.repeat(np.arange(len(parts)), count)
        ends, flat = ends.tolist(), q.tolist()
        out = [tuple(flat[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
        if (q < 0).any():
            place = place.tolist()
            for r in np.unique(row[q < 0]).tolist():
                here = slice(ends[r - 1] if r else 0, ends[r])
                out[r] = tuple(chain.from_iterable((x,) if x >= 0 else self.spelled(parts[r][a - 1]) for x, a in zip(flat[here], place[here], strict=True)))
        return out

    def spelled(self, c: str) -> list[int]:
        """B's output for a character."""
        return [self.byte[b] for b in c.encode("utf-8", "surrogatepass")]

    def relax_long(self, part: str) -> tuple[int, ...]:
        """The same relaxation for one part of any length, arc by arc."""
        n, letters, arcs, inf = len(part), self.letters, self.arcs, float("inf")
        codes = self.letter[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)].tolist()
        ends, weight, unknown = self.ends, self.weight, self.unknown
        dist, last, back = [inf] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        dist[0] = np.float32(0)
        known: dict[tuple[int, int], bool] = {}
        for j in range(n):
            if dist[j] == inf:
                continue
            node, k, some, p = 0, j, False, last[j]
            while k < n:
                node = arcs.get(node * letters + codes[k], -1)
                if node < 0:
                    break
                k += 1
                q = int(ends[node])
                if q < 0:
                    continue
                some = some or k == j + 1
                total = dist[j] + weight[q]
                if total < dist[k]:
                    if self.merging:
                        if (p, q) not in known:
                            known[p, q] = bool(self.compatible(np.array([p]), np.array([q]))[0])
                        if not known[p, q]:
                            continue
                    dist[k], last[k], back[k] = total, q, j
            if not some and dist[j] + unknown < dist[j + 1]:
                dist[j + 1], last[j + 1], back[j + 1] = dist[j] + unknown, -1, j
        out: list[list[int]] = []
        while n:
            out.append([last[n]] if last[n] >= 0 else self.spelled(part[n - 1]))
            n = back[n]
        return tuple(chain.from_iterable(out[::-1]))

    def cut(self, part: str) -> list[str]:
        """A long part at the places that every path passes."""
        out, at, single, inner = [], 0, self.single, self.inner
        for k in range(1, len(part)):
            if part[k - 1 : k + 1] not in inner or part[k] not in single:
                out.append(part[at:k])
                at = k
        return [*out, part[at:]]

    def learn(self, parts: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """Ids of parts that are not remembered; those up to LONGEST are remembered from now on."""
        short, long, extra = [], {}, {}
        parts = set(parts)
        if self.older:
            again = parts.intersection(self.older)
            self.known.update(zip(again, map(self.older.__getitem__, again), strict=True))
            parts -= again
        short = sorted(parts, key=len)
        while short and len(short[-1]) > LONGEST:
            p = short.pop()
            long[p] = self.cut(p)
        between = {x for xs in long.values() for x in xs}
        if between:
            short = sorted(parts.difference(long).union(x for x in between if len(x) <= LONGEST and x not in self.known), key=len)
        at = 0
        while at < len(short):
            end = at + 1
            while end < len(short) and (end - at) * (len(short[end]) + 1) < CELLS:
                end += 1
            group = short[at:end]
            self.known.update(zip(group, self.relax(group), strict=True))
            at = end
        whole = {x: self.relax_long(x) for x in between if len(x) > LONGEST}
        for p, xs in long.items():
            extra[p] = tuple(chain.from_iterable(whole[x] if x in whole else self.known[x] for x in xs))
        return extra

    def parts_of(self, text: str) -> list[str]:
        """The normalised text, cut before blanks."""
        n = self.normalise
        if n.plain and n.prefix and text and "  " not in text and BLANK not in text and text[0] != " " and text[-1] != " ":
            return f"{BLANK}{text}".replace(" ", f" {BLANK}").split(" ")
        return re.findall(f"{BLANK}*[^{BLANK}]+|{BLANK}+", n(text))

    def encode_all(self, texts: list[str]) -> list[array]:
        cut = [self.parts_of(t) for t in texts]
        if len(self.known) >= REMEMBERED:
            self.older, self.known = self.known, {}
        extra = self.learn(set(chain.from_iterable(cut)).difference(self.known))
        if extra:
            get = lambda p: extra[p] if p in extra else self.known[p]
            return [array("i", chain.from_iterable(map(get, parts))) for parts in cut]
        return [array("i", chain.from_iterable(map(self.known.__getitem__, parts))) for parts in cut]

    def encode(self, text: str) -> array:
        return self.encode_all([text])[0]

    def decode(self, ids) -> str:
        """The text of ids; bytes that are not UTF-8 become replacement characters."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.normalise.prefix and text[:1] == " " else text

    def shown(self, text: str) -> str:
        """What the ids of a text decode to: the text itself, but for blank symbols and the model's rewriting."""
        if self.normalise.plain:
            return text.replace(BLANK, " ")
        out = self.normalise(text).replace(BLANK, " ")
        return out[1:] if self.normalise.prefix and out[:1] == " " else out


_compiled: dict[int, Transducer] = {}


def compiled(model: bytes) -> Transducer:
    """One machine, and its memory, for each worker process."""
    key = hash(model)
    if key not in _compiled:
        _compiled[key] = Transducer(model)
    return _compiled[key]


def encode(docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id, n_chars, n_tokens, token_ids, round_trip: whether the ids decode to the text (as
    normalised; blank symbols are spaces). The
    model file is read by the driver and broadcast; it does not grow with the data."""
    spark = docs.sparkSession
    prepare(spark)
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        machine = compiled(model.value)
        texts = strings(batch.column("text"))
        ids, same = [], []
        for t, got in zip(texts, machine.encode_all(texts), strict=True):
            ids.append(np.frombuffer(got, np.int32) if len(got) else np.zeros(0, np.int32))
            same.append(machine.decode(got) == machine.shown(t))
        sizes = np.array([len(i) for i in ids], np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(sizes), lists, pa.array(same)], names=["doc_id", "n_chars", "n_tokens", "token_ids", "round_trip"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_chars long, n_tokens long, token_ids array<int>, round_trip boolean")


def decode(tokens: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id, text from doc_id, token_ids. Null ids give null text."""
    spark = tokens.sparkSession
    prepare(spark)
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        machine = compiled(model.value)
        texts = [None if ids is None else machine.decode(ids) for ids in batch.column("token_ids").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return map_arrow(tokens.select("doc_id", F.col("token_ids")), run, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, text string")


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they decode to it."""
    return encode(table(spark, sf_dir, "documents"))


def encode_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: ids of all documents."""
    return encode(docs)
