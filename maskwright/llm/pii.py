"""Personal data by weak-supervision aggregation.

1. Candidates. The four base kinds (email, ip, card, phone) are found by fixed rules; further spans (secret, iban, ssn,
   person, and cards and phones next to other digits) by loose patterns that also match much that is harmless.
2. Votes. Several labelers look at each candidate - regex (strict form), checksum, gazetteer (word lists), context before
   and context after - and each says personal (1), harmless (-1) or nothing (0).
3. Aggregation. Equal votes are counted over all documents, so that there are at most kinds * 3^labelers rows.
   Expectation-maximisation over these counts estimates each labeler's reliability and each vote pattern's probability
   (Dawid and Skene's model).
4. Classifier. A logistic model over votes and shape features is fitted to those probabilities. Equal candidates are counted
   together first; of the distinct ones, at most `max_rows` take part, an equal share for each kind (those with the smallest
   hash), each weighing by the logarithm of its copies. It decides on every further candidate. Base spans always stay.

Texts are searched once: scan() gives each document's candidates with votes and shapes, and both the training and the
decisions read that table.

Offsets are code points, ends exclusive. Within a kind, spans are leftmost and don't overlap; kinds may overlap.

Defined cases. Null text: as empty, no spans. Null doc_id: kept. No candidates at all: no model, no further spans. Empty
tables give an empty result; repeated rows are each searched. Other columns are ignored by find() and kept by mask().
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import fit_logistic, logistic, lowest, map_arrow, prepare, saved, strings, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "iban", "ssn", "person")
LABELERS = ("form", "checksum", "gazetteer", "before", "after")

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The lookbehinds change no match - a number that can start inside a run of digits can also start at its beginning - but
# keep the search linear on long runs.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOOSE = {
    # what the base rule drops because other digits stand before or after the number
    "card": re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])"),
    # likewise: country code, area code, 3-4 grouping; the base pattern runs on into numbers behind it
    "phone": re.compile(r"(?<![0-9+])\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])"),
    # signed web tokens, or one word, of any length
    "secret": re.compile(r"(?<![A-Za-z0-9_])(?:eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*[A-Za-z0-9_]|[A-Za-z0-9_]{20,}(?![A-Za-z0-9_]))"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
}

#: Words that stand before or after a kind, and lists of known members.
CUES = {
    "email": "mail email e-mail contact write reply address from to".split(),
    "ip": "ip host server address addr client ping from".split(),
    "card": "card visa mastercard amex credit payment pay cc number".split(),
    "phone": "phone tel telephone call mobile fax cell number whatsapp".split(),
    "secret": "token secret key apikey api_key password passwd auth bearer credential access".split(),
    "iban": "iban account bank transfer konto cuenta compte".split(),
    "ssn": "ssn social security insurance".split(),
    "person": "name called signed sincerely regards dear contact by author customer patient sir".split(),
}
HARMLESS = "sha sha1 sha256 md5 commit checksum hash version build part isbn order invoice id".split()
MAIL_DOMAINS = frozenset("com org net edu gov mil int info biz name pro aero coop museum app dev io ai cloud online site tech store shop blog news me tv cc ac eu uk ie fr de at ch nl be lu it es pt pl cz sk hu ro bg gr tr se no dk fi is ee lv lt ru ua us ca mx br ar cl co pe ve au nz in pk bd lk cn hk tw jp kr sg my th vn id ph za ng ke eg ma tn il sa ae qa ir iq".split())
IBAN_LENGTHS = {"DE": 22, "FR": 27, "ES": 24, "IT": 27, "GB": 22, "NL": 18, "BE": 16, "CH": 21, "AT": 20, "PT": 25, "IE": 22, "LU": 20, "PL": 28, "SE": 24, "DK": 18, "FI": 18, "NO": 15}
FIRST_NAMES = frozenset("aaron adam adrian agnes ahmed alain alan albert alessandro alex alexander alfred ali alice amanda amelie amy ana andrea andreas andrew angela anja anna anne anton antonio arthur barbara beatrice ben benjamin bernard brian brigitte bruno camille carla carlos carmen carol caroline catherine charles charlotte chiara chris christian christina christine claire clara claude claudia daniel david deborah diego dieter dominique donald dorothy edward elena elisabeth elizabeth emil emily emma enrico eric erik eva fatima felix fernando florian francesca francesco francisco francois frank fritz gabriel george gerard gerhard giovanni giulia grace gustav hannah hans heinrich helen helena henri henry ines ingrid isabel jack jacques james jan jane jason javier jean jennifer jessica joan johann john jonas jorge jose joseph juan judith julia julie julien karen karl kate katharina kevin klaus laura lena leo leonie lisa louis louise luca lucas lucia luis luisa lukas manuel marco margaret maria marie mario mark markus marta martin mary matteo matthew max maya mia michael michel miguel mohammed monica nadia nathalie nicolas nina nora olga oliver olivia omar otto pablo patricia patrick paul paula pedro peter philip pierre rachel rafael raul rebecca renate richard robert rosa ruth samuel sandra sara sarah sebastian silvia simon sofia sophie stefan stefano stephanie stephen steven susan susanne sylvie teresa thierry thomas tim tom ursula valentina vera veronica victor victoria vincent walter werner william wolfgang yusuf yves".split())

#: A capital letter of any script and small ones, parts of it joined by hyphens or apostrophes.
NAME = r"(?:\p{Lu}['’])?\p{Lu}[\p{Ll}\p{M}]++(?:[-'’]\p{Lu}[\p{Ll}\p{M}]++)*+"
#: A title or an introduction, then the name (group 1); and several capitalised words, of which the first is a known name.
INTRODUCED = regex.compile(r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Sr|Sra|[Mm]y name is|[Ss]igned|[Cc]ontact|[Rr]egards|[Dd]ear)[.:,]?\s((?:" + NAME + r"\x20){0,2}" + NAME + r")(?!\p{L})")
CAPITALISED = regex.compile(r"(?<!\p{L})" + NAME + r"(?:\x20" + NAME + r"){1,2}(?!\p{L})")
#: Letters that are no others with marks on them.
_PLAIN = str.maketrans("łøđıþ", "lodit")


def known_name(word: str) -> bool:
    """Is it a first name of the list, marks on its letters aside?"""
    low = word.lower()
    return low in FIRST_NAMES or (not low.isascii() and "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c)).translate(_PLAIN) in FIRST_NAMES)


DIGIT = re.compile(r"[0-9]")
#: Kinds whose candidates hold a digit.
NUMBERED = ("card", "phone", "iban", "ssn")


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping addresses, found from each @ outwards, so in linear time."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(Span("email", start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))
    return out


def base_spans(text: str) -> list[Span]:
    out = emails(text)
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append(Span("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(Span("card", *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(Span("phone", *m.span()))
    return out


def people(text: str) -> list[Span]:
    """Names behind a title or an introduction, and those that begin with a known first name; leftmost, then longest."""
    found = [m.span(1) for m in INTRODUCED.finditer(text)]
    found += [m.span() for m in CAPITALISED.finditer(text) if known_name(m[0].partition(" ")[0])]
    out: list[Span] = []
    for start, end in sorted(found, key=lambda s: (s[0], -s[1])):
        if not out or start >= out[-1].end:
            out.append(Span("person", start, end))
    return out


def further_candidates(text: str, base: list[Span]) -> list[Span]:
    """Loose matches that are not inside a base span; cards must pass Luhn's test here too."""
    digits = DIGIT.search(text)
    found = [Span(kind, *m.span()) for kind, p in LOOSE.items() if digits or kind not in NUMBERED for m in p.finditer(text)] + people(text)
    if base and found:
        # base spans of one kind do not overlap: of each kind, only the last that starts no later can hold a candidate
        lists = {k: sorted((b.start, b.end) for b in base if b.kind == k) for k in BASE}
        holds = lambda s, l: (i := bisect_right(l, (s.start, math.inf))) and l[i - 1][1] >= s.end  # noqa: E731, E741
        found = [s for s in found if not any(holds(s, l) for l in lists.values())]  # noqa: E741
    return [s for s in found if s.kind != "card" or luhn(text[s.start : s.end].replace(" ", "").replace("-", ""))]


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


WORDS_BEFORE = re.compile(r"[A-Za-z_-]+")


def votes(text: str, span: Span) -> tuple[int, ...]:
    """What LABELERS say: 1, -1 or 0."""
    kind, value = span.kind, text[span.start : span.end]
    digits = [c for c in value if c.isdigit()]
    before = [w.lower() for w in WORDS_BEFORE.findall(text[max(0, span.start - 32) : span.start])][-3:]
    after, glued = text[span.end : span.end + 1], text[max(0, span.start - 1) : span.start]
    form = checksum = gazetteer = 0
    if kind == "email":
        form = 1 if 3 <= len(value) <= 254 and ".." not in value else -1
        gazetteer = 1 if value.rpartition(".")[2].lower() in MAIL_DOMAINS else 0
    elif kind == "ip":
        form = 1 if all(len(p) <= 3 and (p == "0" or p[0] != "0") for p in value.split(".")) else -1
        gazetteer = -1 if value.split(".")[0] in ("0", "127", "255") else 0
    elif kind == "card":
        form = 1 if len(digits) in (13, 15, 16) else -1
        checksum = 1 if luhn("".join(digits)) else -1
        gazetteer = 1 if digits[0] in "3456" else -1
    elif kind == "phone":
        form = 1 if 10 <= len(digits) <= 13 else 0
        gazetteer = -1 if digits[0] == "0" else 1
    elif kind == "secret":
        mixed = len(digits) >= 3 and any(c.isalpha() for c in value)
        form = 1 if mixed and (len(value) in (20, 24, 32, 36, 40, 48) or len(value) >= 64) else -1 if not mixed else 0
        checksum = 1 if mixed and entropy(value) >= 3.2 else -1
        gazetteer = 1 if re.fullmatch(r"[0-9a-f]{32,64}|(AKIA|ghp_|sk_|xox)[A-Za-z0-9_]+|eyJ[^.]+\.[^.]+\..+", value) else -1 if value.isalpha() or value.isdigit() else 0
    elif kind == "iban":
        plain = value.replace(" ", "")
        form = 1 if IBAN_LENGTHS.get(plain[:2]) == len(plain) else -1
        checksum = 1 if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 else -1
        gazetteer = 1 if plain[:2] in IBAN_LENGTHS else -1
    elif kind == "ssn":
        form = -1 if value[:3] in ("000", "666") or value[0] == "9" or value[4:6] == "00" or value[7:] == "0000" else 1
    elif kind == "person":
        known = sum(map(known_name, value.split()))
        form = 1 if 2 <= len(value.split()) <= 3 else 0
        gazetteer = 1 if known else -1
        checksum = 1 if re.search(r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Sr|Sra)[.:,]?\s$", text[max(0, span.start - 12) : span.start]) else 0  # a title
    cue = 1 if any(w.strip("-") in CUES[kind] for w in before) else -1 if any(w in HARMLESS for w in before) or kind == "secret" else 0
    tail = 1 if not after or after in " \n\t\"',;)" else -1 if after.isalnum() or after in "/\\_=" or glued in ("/", "=", "_") else 0
    return form, checksum, gazetteer, cue, tail


SHAPE = 6


def shape(text: str, span: Span) -> list[float]:
    """What the span and its edges look like."""
    value = text[span.start : span.end]
    n = len(value)
    return [math.log1p(n) / 5, sum(c.isdigit() for c in value) / n, sum(c.isupper() for c in value) / n, entropy(value) / 6, float(text[max(0, span.start - 1) : span.start] in ("\"", "'")), float("=" in text[max(0, span.start - 4) : span.start])]


def design(kinds: list[str], votes: list[list[int]], shapes: list[list[float]]) -> np.ndarray:
    """For the classifier, a row for each candidate: the kind, each labeler's two votes, and the shape."""
    v = np.array(votes, np.int8).reshape(-1, len(LABELERS), 1)
    return np.hstack([np.array(kinds, object)[:, None] == np.array(KINDS, object), (v == np.array([1, -1])).reshape(len(kinds), -1), np.array(shapes, float).reshape(-1, SHAPE)]).astype(float)


def aggregate(counts: dict[tuple[str, tuple[int, ...]], int], rounds: int = 50) -> tuple[dict[tuple[str, tuple[int, ...]], float], dict[str, np.ndarray]]:
    """Expectation-maximisation. Returns the probability that each vote pattern is personal data, and for each kind the
    table P(vote | truth) of shape (labelers, 3 votes, 2 truths). Smoothing: one pseudo-count a cell; the vote that agrees
    with the truth gets a tenth of the candidates more, which keeps the two truths from changing places."""
    probability, tables = {}, {}
    for kind in dict.fromkeys(k for k, _ in counts):
        patterns = sorted(v for k, v in counts if k == kind)
        n = np.array([counts[kind, v] for v in patterns], float)
        at = np.array(patterns) + 1  # 0: harmless, 1: nothing, 2: personal
        one_hot = np.eye(3)[at]  # pattern, labeler, vote
        p = logistic(1.5 * (at - 1).sum(axis=1))
        prior = np.ones((len(LABELERS), 3, 2))
        prior[:, 2, 1] += 0.1 * n.sum()
        prior[:, 0, 0] += 0.1 * n.sum()
        for _ in range(rounds):
            both = np.stack([1 - p, p]) * n  # truth, pattern
            t = np.einsum("tp,plv->lvt", both, one_hot) + prior
            t /= t.sum(axis=1, keepdims=True)
            share = np.log((both.sum(axis=1) + 1) / (n.sum() + 2))
            ll = np.einsum("plv,lvt->tp", one_hot, np.log(t)) + share[:, None]
            new = logistic(ll[1] - ll[0])
            if np.abs(new - p).max() < 1e-9:
                break
            p = new
        tables[kind] = t
        probability |= {(kind, v): float(x) for v, x in zip(patterns, p, strict=True)}
    return probability, tables


class Model(NamedTuple):
    """weights of the span classifier; None: there was nothing to learn from."""

    weights: np.ndarray | None
    threshold: float = 0.5

    def accepts(self, kinds: list[str], votes: list[list[int]], shapes: list[list[float]]) -> np.ndarray:
        if self.weights is None or not kinds:
            return np.zeros(len(kinds), bool)
        return logistic(design(kinds, votes, shapes) @ self.weights[:-1] + self.weights[-1]) >= self.threshold


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.list_(pa.int8())), ("shape", pa.list_(pa.float32()))])


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, as k0, k1, ..., and spans: all candidates of the text, by start, kind as listed and end."""
    prepare(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for t in strings(batch.column("t")):
            base = base_spans(t)
            marked = [(s, True) for s in base] + [(s, False) for s in further_candidates(t, base)]
            marked.sort(key=lambda x: (x[0].start, KINDS.index(x[0].kind), x[0].end))
            rows.append([{"kind": s.kind, "start": s.start, "end": s.end, "base": b, "votes": votes(t, s), "shape": shape(t, s)} for s, b in marked])
        return pa.RecordBatch.from_arrays([*(batch.column(f"k{i}") for i in range(len(keep))), pa.array(rows, pa.list_(SPAN))], names=[*(f"k{i}" for i in range(len(keep))), "spans"])

    schema = ", ".join([*(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), "spans array<struct<kind:string,start:int,end:int,base:boolean,votes:array<tinyint>,shape:array<float>>>"])
    return map_arrow(docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col("text").alias("t")), run, schema)


def fit(scanned: DataFrame, max_rows: int = 20_000) -> Model:
    """Fit the classifier to the candidates of a scanned (and saved) table. Only counts of vote patterns and at most max_rows
    distinct candidates reach the driver."""
    each = scanned.select(F.explode("spans").alias("s")).select("s.kind", "s.votes", "s.shape")
    distinct = saved(each.groupBy("kind", "votes", "shape").agg(F.count("*").alias("n")), "pii-distinct")
    found = distinct.groupBy("kind", "votes").agg(F.sum("n").alias("n"), F.count("*").alias("different")).collect()
    if not found:
        return Model(None)
    counts = {(r.kind, tuple(r.votes)): r.n for r in found}
    probability, _ = aggregate(counts)
    different: Counter = Counter()
    for r in found:
        different[r.kind] += r.different
    share = max_rows / len(different)  # of each kind
    h = F.xxhash64(F.lit("kind"), "votes", "shape")
    low = [(F.col("kind") == k) & (h < F.lit(int(min(2**63 - 1, -(2**63) + share / n * 2**64)))) for k, n in different.items()]
    chosen = low[0]
    for x in low[1:]:
        chosen = chosen | x
    rows = lowest(distinct.filter(chosen), max_rows, "kind", "votes", "shape").collect()
    x = design([r.kind for r in rows], [r.votes for r in rows], [r.shape for r in rows])
    y = np.array([probability[r.kind, tuple(r.votes)] for r in rows])
    weight = 1 + np.log(np.array([r.n for r in rows], float))
    # vote patterns that the sample may lack, once each, so that every kind and labeler is covered
    more = list(counts)
    own = {k: x[x[:, KINDS.index(k)] == 1, -SHAPE:] for k in different}
    extra = design([k for k, _ in more], [v for _, v in more], [own[k].mean(axis=0) if len(own[k]) else np.full(SHAPE, 0.5) for k, _ in more])
    x, y, weight = np.vstack([x, extra]), np.append(y, [probability[m] for m in more]), np.append(weight, np.ones(len(more)))
    return Model(fit_logistic(x, y, 0.1, weight=weight))


def train(docs: DataFrame, max_rows: int = 20_000) -> Model:
    """Fit the classifier to the candidates of all documents, which are written to the shared folder."""
    return fit(saved(scan(docs, ()), "pii-candidates"), max_rows)


def decided(rows: list[list[dict]], model: Model) -> list[list[dict]]:
    """Of each document's candidates the base spans and those that the model accepts."""
    doubt = [s for spans in rows for s in spans if not s["base"]]
    good = iter(model.accepts([s["kind"] for s in doubt], [s["votes"] for s in doubt], [s["shape"] for s in doubt]))
    return [[s for s in spans if s["base"] or next(good)] for spans in rows]


def written(spans: list[dict]) -> str:
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)


def found_in(scanned: DataFrame, model: Model) -> DataFrame:
    """doc_id (k0), n_email, n_ip, n_card, n_phone (base spans of the kind), base_sha256, spans, n_further."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {f"n_{k}": [] for k in BASE} | {"base_sha256": [], "spans": [], "n_further": []}
        for spans in decided(batch.column("spans").to_pylist(), model):
            base = [s for s in spans if s["base"]]
            n = Counter(s["kind"] for s in base)
            for k in BASE:
                out[f"n_{k}"].append(n[k])
            out["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
            out["spans"].append(written(spans))
            out["n_further"].append(len(spans) - len(base))
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("k0")} | {k: pa.array(v, pa.string() if k in ("base_sha256", "spans") else pa.int64()) for k, v in out.items()})

    kind = scanned.schema["k0"].dataType.simpleString()
    return map_arrow(scanned.select("k0", "spans"), run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_further long")


def find(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans of the kind), base_sha256, spans, n_further."""
    return found_in(scan(docs), model)


def masked(text: str, spans: list[Span], label: Callable[[str], str] = lambda kind: f"[{kind.upper()}]") -> str:
    """Each span replaced by its label; overlapping spans together by the label of the one that starts first."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            out += [text[at : s.start], label(s.kind)]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def masked_in(scanned: DataFrame, columns: list[str], model: Model) -> DataFrame:
    """The scanned columns (k0, ... for `columns`) with every span in text masked; n_chars, if there, follows the new text."""
    at = columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = decided(batch.column("spans").to_pylist(), model)
        texts = [None if t is None else masked(t, [Span(s["kind"], s["start"], s["end"]) for s in spans]) for t, spans in zip(batch.column(f"k{at}").to_pylist(), rows, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else batch.column(f"k{i}") for i in range(len(columns))], names=[f"k{i}" for i in range(len(columns))])

    kept = [f for f in scanned.schema if f.name != "spans"]
    out = map_arrow(scanned, run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)).toDF(*columns)
    return out.withColumn("n_chars", F.length("text").cast(kept[columns.index("n_chars")].dataType)) if "n_chars" in columns else out


def mask(docs: DataFrame, model: Model) -> DataFrame:
    """docs with every span in text masked; n_chars, if there, follows the new text. Null texts stay null."""
    return masked_in(scan(docs, tuple(docs.columns)), docs.columns, model)


def op3_pii(spark, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    scanned = saved(scan(table(spark, sf_dir, "documents")), "pii-candidates")
    return found_in(scanned, fit(scanned))


def mask_pii(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents, personal data masked."""
    scanned = saved(scan(docs, tuple(docs.columns)), "pii-candidates")
    return masked_in(scanned, docs.columns, fit(scanned))
