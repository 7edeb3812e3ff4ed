import json

import pytest
from pyspark.sql import functions as F

from maskwright.functions import checksums as C, text as X


def one(spark, column, **values):
    types = {str: "string", int: "long", list: "array<double>"}
    ddl = ", ".join(f"{k} {types[type(v)] if v is not None else 'string'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], ddl).select(column.alias("y")).first().y


def test_contains_is_literal_and_null_safe(spark):
    f = X.literal_contains(F.col("t"), F.col("v"))
    assert one(spark, f, t="a%b", v="%") is True
    assert one(spark, f, t="abc", v="A") is False
    assert one(spark, f, t=None, v="a") is False
    assert one(spark, f, t="abc", v="") is True


def test_strip_and_overlap(spark):
    assert one(spark, X.strip(F.col("t")), t="\t a b \n") == "a b"
    assert one(spark, X.overlap_folded(F.col("a"), F.col("b")), a=" JOHN\n", b="john smith") is True
    assert one(spark, X.overlap_exact(F.col("a"), F.col("b")), a="JOHN", b="john smith") is False


@pytest.mark.parametrize(("pii", "out", "want"), [("Zoé Élan", "Zoé left", True), ("Élan Zoé", "the Élan", False), ("Bob Li", "Bob x", True), ("Bob Li", "Bob Li", False), ("long word", "word", False)])
def test_strict(spark, pii, out, want):
    # words of fewer than four characters do not count, unless there are no others
    assert one(spark, X.strictly_absent(F.col("p"), F.col("o")), p=pii, o=out) is want


@pytest.mark.parametrize("t", ["", " ", "a", "a b c", "one\ttwo\nthree  four five", "é 😀"])
def test_token_estimate(spark, t):
    assert one(spark, X.token_estimate(F.col("t")), t=t) == len(t.split()) * 4 // 3


@pytest.mark.parametrize(("t", "term"), [("abcabcab", "ab"), ("aaaa", "aa"), ("a.b.c", "."), ("x\\Ey\\E", "\\E"), ("none", "zz"), ("a😀b😀", "😀"), ("abc", "")])
def test_occurrences(spark, t, term):
    starts, at = [], t.find(term) if term else -1
    while at >= 0:
        starts.append(at)
        at = t.find(term, at + len(term))
    assert one(spark, X.occurrence_starts(F.col("t"), F.col("v")), t=t, v=term) == starts
    assert one(spark, X.occurrences(F.col("t"), F.col("v")), t=t, v=term) == len(starts)


@pytest.mark.parametrize("t", ["plain", "é\"\\\n", "a😀b", "\x7f\x1f"])
def test_ascii_json(spark, t):
    got = one(spark, X.ascii_note(F.col("t")), t=t)
    assert got.isascii() and json.loads(got) == {"note": t}


@pytest.mark.parametrize(("n", "p"), [(30, 95), (30, 99), (1, 95), (100, 95), (100, 99)])
def test_nearest_rank(spark, n, p):
    values = [float((i * 37) % n) for i in range(n)]
    assert one(spark, X.nearest_rank(F.col("v"), float(p)), v=values) == sorted(values)[min(int(n * p / 100), n - 1)]


def test_shown_rounds_halves_to_even(spark):
    assert one(spark, X.shown(F.lit(62.25))) == 62.2


def test_checksums(spark):
    assert one(spark, C.luhn(F.col("v")), v="4111 1111-1111 1111") is True
    assert one(spark, C.luhn(F.col("v")), v="4111111111111112") is False
    assert one(spark, C.iban(F.col("v")), v="DE89 3704 0044 0532 0130 00") is True
    assert one(spark, C.iban(F.col("v")), v="DE88370400440532013000") is False
    assert one(spark, C.nhs(F.col("v")), v="943 476 5919") is True
    assert one(spark, C.nhs(F.col("v")), v="943 476 5918") is False
    assert one(spark, C.octets(F.col("v")), v="1.2.3.255") is True
    assert one(spark, C.octets(F.col("v")), v="1.2.3.256") is False
