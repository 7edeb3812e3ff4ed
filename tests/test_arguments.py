import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from maskwright.operators import arguments as A, payload as P
from maskwright.operators.detect import REGISTRY, Rule

RULES = [REGISTRY["email"], REGISTRY["card"], Rule("ip", "IP_ADDRESS", "[0-9]+(?:[.][0-9]+){3}")]
CARD, MAIL = "4111111111111111", "zoe@ex.test"


def calls(*arguments):
    return [("assistant", None, None, [(f"c{i}", "function", ("keep", a)) for i, a in enumerate(arguments)])]


def tricky():
    inner = json.dumps({"mail": MAIL, "n": int(CARD), "deep": json.dumps([{"again": f"to {MAIL}\nand \"x\""}])})
    return [
        '{"card": 4111111111111111, "ok": 12.50, "e": 1e5}',
        json.dumps({MAIL: 1, "plain": {CARD: [MAIL, None, True]}}),
        json.dumps({"body": inner}),
        json.dumps([json.dumps(json.dumps([inner]))]),
        '{"esc": "zoe\\u0040ex.test", "slash": "a\\/b", "uni": "Zo\\u00e9 10.0.0.1"}',
        "no json, but zoe@ex.test",
        f"  [ {CARD} ,\n{CARD}.0, -5 ]  ",
        "", "null", '""', "[]", "{", '"' + MAIL + '"', CARD,
    ]


def parsed(text):
    try:
        out = json.loads(text)
    except ValueError:
        return text
    return opened(out)


def opened(x):
    if isinstance(x, dict):
        return {k: opened(v) for k, v in x.items()}
    if isinstance(x, list):
        return [opened(v) for v in x]
    return parsed(x) if isinstance(x, str) and x[:1] in "[{" else x


def test_nothing_leaks_from_trees_and_all_comes_back(spark):
    given = tricky()
    df = spark.createDataFrame([(i, calls(a)) for i, a in enumerate(given)], f"i int, messages {P.MESSAGES}")
    done = A.redact_payloads(df, RULES)
    rows = {r.i: r for r in done.collect()}
    for i, a in enumerate(given):
        out = rows[i].messages[0].tool_calls[0].function.arguments
        for text in A.texts_of(out) + [out]:
            assert MAIL not in text and CARD not in text and "10.0.0.1" not in text, (a, out)
        assert A.is_json(out) == A.is_json(a)
    assert rows[0].messages[0].tool_calls[0].function.arguments == '{"card": "\\u003cCREDIT_CARD_1>", "ok": 12.50, "e": 1e5}'
    back = {r.i: r.messages[0].tool_calls[0].function.arguments for r in A.restore_payloads(done).collect()}
    for i, a in enumerate(given):
        assert parsed(back[i]) == parsed(a), a
    assert back[0] == given[0] and back[6] == given[6] and back[5] == given[5]


def test_one_mapping_for_all_parts(spark):
    messages = [("user", f"I am {MAIL}", None, None), ("user", None, [("text", f"pay {CARD}", None), ("image_url", None, ("u",))], None), *calls(json.dumps({"to": MAIL}), None)]
    df = spark.createDataFrame([(messages, ["EMAIL_ADDRESS"]), (messages, ["CREDIT_CARD", "EMAIL_ADDRESS"]), (None, []), ([], [])], f"messages {P.MESSAGES}, types array<string>")
    got = A.redact_payloads(df, RULES, allow="types").collect()
    flat = [[m.content_text, [p.text for p in m.content_parts or []], [c.function.arguments for c in m.tool_calls or []]] for r in got[:2] for m in r.messages]
    assert flat[0][0] == "I am <EMAIL_ADDRESS_1>" and flat[1][1] == [f"pay {CARD}", None] and flat[2][2] == ['{"to": "<EMAIL_ADDRESS_1>"}', None]
    assert flat[4][1] == ["pay <CREDIT_CARD_1>", None]
    assert {(m.original, m.fake) for m in got[1].mapping} == {(MAIL, "<EMAIL_ADDRESS_1>"), (CARD, "<CREDIT_CARD_1>")}
    assert got[2].messages is None and got[3].messages == []


@pytest.mark.parametrize("seed", range(3))
def test_random_trees(seed):
    rng = random.Random(seed)
    leaf = lambda: rng.choice([MAIL, f"x {MAIL} y", int(CARD), 3.5, None, True, "é\"\\\n", "", "<EMAIL_ADDRESS_1"])

    def tree(depth):
        kind = rng.randint(0, 4) if depth else 0
        if kind == 1:
            return {rng.choice(["a", "b", MAIL, "é"]): tree(depth - 1) for _ in range(3)}
        if kind == 2:
            return [tree(depth - 1) for _ in range(rng.randint(0, 3))]
        if kind == 3:
            return json.dumps(tree(depth - 1), ensure_ascii=rng.random() < 0.5)
        return leaf()

    swap = lambda t: t.replace(MAIL, "<EMAIL_ADDRESS_1>").replace(CARD, "<CREDIT_CARD_1>")
    for _ in range(200):
        given = json.dumps(tree(5), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        out = A.walk(given, swap)
        assert not any(MAIL in t or CARD in t for t in A.texts_of(out))
        assert parsed(A.back(out, {"<EMAIL_ADDRESS_1>": MAIL, "<CREDIT_CARD_1>": CARD})) == parsed(given)


def test_deep_lists_are_one_text():
    deep = "[" * 100_000
    assert A.texts_of(deep) == [deep]


def test_payloads_are_taken_apart_in_small_batches(spark):
    """10,000 payloads came to Python in one batch, however long, and 512 of any length were taken apart at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    df = spark.range(1500).coalesce(1).select("id", F.repeat(F.lit("long text "), F.when(F.col("id") % 500 == 7, 200_000).otherwise(50)).alias("text"))
    sizes = A._mapped(df, lambda b: pa.RecordBatch.from_pydict({"n": [b.num_rows], "bytes": [b.nbytes]}), StructType.fromDDL("n long, bytes long")).collect()
    assert sum(r.n for r in sizes) == 1500 and max(r.n for r in sizes) <= A.ROWS
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "512"
    assert all(r.n <= 128 and r.bytes < 9 << 20 for r in sizes)
