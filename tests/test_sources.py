import json
import random

from pyspark.sql import functions as F

from maskwright import cli
from maskwright.operators import conversation
from maskwright.operators.detect import REGISTRY, Rule
from maskwright.plans import reports
from maskwright.sources import json_arrays, readers, schema, sinks
from maskwright.streaming.redaction import redact_conversation_stream, redact_stream, windowed_counts

SAMPLES = [
    {"id": "t1", "lang": "fr", "source": "own", "text": "Je suis Zoé Élan, zoe@ex.test, 192.0.2.7.", "expected": {"Zoé Élan": "PERSON", "zoe@ex.test": "EMAIL_ADDRESS", "192.0.2.7": "IP_ADDRESS"}, "must_preserve": ["suis"]},
    {"id": "t2", "text": "Rien, 12 et 3.14.", "expected": {}, "tokens_estimate": 4},
    {"id": "t3", "lang": "en", "text": "Call +1 (523) 555-1055\nor zoe@ex.test", "expected": {"+1 (523) 555-1055": "PHONE_NUMBER", "zoe@ex.test": "EMAIL_ADDRESS"}},
]


def corpus(spark, tmp_path, name="own", samples=SAMPLES):
    path = tmp_path / f"{name}.json"
    path.write_text(json.dumps(samples, indent=1, ensure_ascii=False), encoding="utf-8")
    return str(path)


def test_corpora_and_optional_files(spark, tmp_path):
    a, b = corpus(spark, tmp_path), corpus(spark, tmp_path, "more", SAMPLES[:1])
    df = readers.corpora(spark, [a, b])
    assert [(r.dataset, r.id) for r in df.orderBy("ord", "id").collect()] == [("own", "t1"), ("own", "t2"), ("own", "t3"), ("more", "t1")]
    r = df.filter("id = 't2'").first()
    assert r.lang is None and r.must_preserve is None and r.tokens_estimate == 4 and r.expected == {}
    assert readers.clean(df).count() == 1
    assert readers.optional_json_array(spark, str(tmp_path / "none.json")).count() == 0
    assert readers.corpora(spark, [str(tmp_path / "none.json")], optional=True).columns[-2:] == ["dataset", "ord"]


def test_structured_messages(spark, tmp_path):
    path = tmp_path / "s.json"
    call = {"id": "1", "type": "function", "function": {"name": "f", "arguments": "free text"}}
    messages = [{"role": "user", "content": "hi"}, {"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image_url", "image_url": {"url": "u"}}]}, {"role": "assistant", "content": None, "tool_calls": [call, call]}]
    path.write_text(json.dumps([{"id": "x", "messages": messages, "expected": {"a": "B"}}]))
    m = readers.structured(spark, str(path)).first().messages
    assert m[0].content_text == "hi" and m[0].content_parts is None
    assert m[1].content_text is None and [p.text for p in m[1].content_parts] == ["a", None]
    assert m[2].content_text is None and len(m[2].tool_calls) == 2


def test_labels_wrapped_or_bare(spark, tmp_path):
    items = [{"id": "1", "lang": "de", "expected": {"x": "PERSON"}}, {"id": "2", "lang": "en", "expected": {}}]
    for name, content in (("w", {"_about": "x", "source_dataset": "y", "labels": items}), ("b", items)):
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(content, indent=2))
        got = readers.labels(spark, str(path))
        assert sorted((r.id, r.lang, tuple(r.expected)) for r in got.collect()) == [("1", "de", ("x",)), ("2", "en", ())]
        texts = spark.createDataFrame([("1", "zz", "a x"), ("9", "zz", "b")], "id string, lang string, text string")
        assert [tuple(r) for r in readers.label_corpus(got, texts).select("id", "lang", "text").collect()] == [("1", "de", "a x")]


def test_masked_sources(spark, tmp_path):
    for lang, n in (("de", 2), ("fr", 1)):
        (tmp_path / f"{lang}.jsonl").write_text("\n".join(json.dumps({"id": i, "source_text": "t", "privacy_mask": [{"label": "CITY", "value": "Ulm"}]}) for i in range(n)))
    df = readers.masked_sources(spark, {"de": str(tmp_path / "de.jsonl"), "fr": str(tmp_path / "fr.jsonl")})
    assert sorted((r.lang, r.id, r.file_ord) for r in df.collect()) == [("de", "0", 0), ("de", "1", 0), ("fr", "0", 1)]
    assert readers.read_table(spark, str(tmp_path / "de.jsonl"), ddl=schema.MASKED).count() == 2
    none = readers.masked_sources(spark, {})
    assert none.columns == df.columns and none.count() == 0


def test_reports_and_sinks(spark, tmp_path):
    df = readers.corpora(spark, [corpus(spark, tmp_path)])
    rules = tuple(REGISTRY[n] for n in ("email", "ip", "phone"))
    found = reports.precision_recall_report(df, reports.Solution("all-types", rules))
    overall = found["overall"].first()
    assert (overall.tp, overall.fn) == (4, 1)  # the name has no cue before it
    assert {r.lang for r in found["by_lang"].collect()} == {None, "fr", "en"}
    parity = {r.carrier: r for r in reports.carrier_report(df, reports.Solution("all-types", rules)).collect()}
    assert all(r.labels == 5 and r.leaked == 1 and r.regressions == 0 and r.rt_failed == 0 for r in parity.values())
    assert parity["flat"].rt_checked == 0 and parity["tool_call"].rt_checked == 3
    flat = {r.carrier: r.leaked for r in reports.carrier_report(df, reports.Solution("flat", rules, structured=False)).collect()}
    assert flat == {"flat": 1, "multimodal": 5, "tool_call": 5, "tool_call_nested": 5}
    compared = reports.comparison_report(df, [reports.Solution("all-types", rules), reports.Solution("flat-only", rules, structured=False)])
    head = {r.solution: r for r in compared["headline"].collect()}
    assert head["all-types"].recall == 80.0 and head["all-types"].tool_protection == 100.0
    assert head["flat-only"].tool_leak == 100.0 and head["flat-only"].recall == 80.0
    assert {r.false_positives for r in compared["clean"].collect()} == {0}
    assert set(compared["by_lang"].columns) == {"solution", "?", "fr", "en"}
    one = reports.comparison_report(df, [reports.Solution("all-types", rules)], langs=["fr", "xx"])["by_lang"].first()
    assert (one["xx"], one["fr"] > 0) == (0.0, True)
    text = sinks.markdown_report("T", compared, ["note"])
    assert "| all-types |" in text and "80.0" in text
    assert json.loads(sinks.json_report(compared))["clean"][0]["clean_docs"] == 1
    sinks.write_table(found["items"], str(tmp_path / "out"), "json")
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_text_tables_and_caveats(spark):
    df = spark.createDataFrame([("a", 5, 62.25, None), ("bcd", 12, 7.0, "x|y")], "name string, n int, recall double, other string")
    assert sinks.text_table(df) == "name   n  recall  other\na      5    62.2\nbcd   12     7.0  x|y"
    assert sinks.text_table(df.limit(0)) == "name  n  recall  other"
    notes = reports.caveats({"x": df})
    assert len(notes) == 1 and notes[0].startswith("recall:") and "recall:" in sinks.text_report("T", {"x": df}, notes)


def test_report_rows_are_bounded(spark):
    import pytest

    with pytest.raises(ValueError):
        sinks.small(spark.range(11), 10)


def test_cli_selftest(spark, tmp_path, capsys):
    assert cli.main(["--corpus", corpus(spark, tmp_path), "--selftest"]) == 0
    assert "0 failures" in capsys.readouterr().out


def test_cli_presets_and_solutions(spark, tmp_path, capsys):
    path = corpus(spark, tmp_path, samples=SAMPLES[1:])
    assert cli.main(["--corpus", path, "--preset", "light"]) == 0
    out = capsys.readouterr().out
    assert "allowlisted: carriers" in out and "all-types" not in out and "flat-only" not in out


def test_cli_selftest_needs_a_complete_baseline(spark, tmp_path, monkeypatch):
    import pytest

    path = corpus(spark, tmp_path)
    whole = cli.Dictionary
    monkeypatch.setattr(cli, "Dictionary", lambda terms: whole(terms[1:]))
    with pytest.raises(AssertionError):
        cli.main(["--corpus", path, "--selftest"])


def test_stream_gives_the_batch_result(spark, tmp_path):
    data = [(f"2024-01-01 00:0{i % 7}:00", f"mail a{i}@b.test") for i in range(20)] + [("2024-01-01 00:01:00", None), ("2024-01-01 00:02:00", "none")]
    df = spark.createDataFrame(data, "ts string, text string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    rules = [Rule("email", "EMAIL_ADDRESS", r"[a-z0-9]+@[a-z.]+")]
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = redact_stream(stream, rules).writeStream.format("memory").queryName("redacted").start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: str(tuple(r))
    assert sorted(map(key, spark.table("redacted").collect())) == sorted(map(key, redact_stream(df, rules).collect()))
    q = windowed_counts(stream, rules).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((str(r.window_start), r.type, r.n) for r in spark.table("counts").collect()) == [("2024-01-01 00:00:00", "EMAIL_ADDRESS", 15), ("2024-01-01 00:05:00", "EMAIL_ADDRESS", 5)]


def test_lines_keep_their_place_over_splits(spark, tmp_path):
    """Files in several splits: the last line of an id wins, as in a Python dict."""
    rng = random.Random(2)
    paths, want, lines = {}, {}, {}
    for k, lang in enumerate(("de", "fr")):
        rows = [{"id": str(rng.randint(0, 90)), "source_text": f"{lang} {i} é" + "x" * rng.randint(0, 90), "privacy_mask": [{"label": "EMAIL", "value": "a@b.c"}]} for i in range(700)]
        paths[lang] = str(tmp_path / f"{lang}.jsonl")
        lines[lang] = [x for r in rows for x in ([json.dumps(r, ensure_ascii=False), ""] if rng.random() < 0.1 else [json.dumps(r, ensure_ascii=False)])]
        (tmp_path / f"{lang}.jsonl").write_text("\n".join(lines[lang]) + "\n")
        want |= {r["id"]: (lang, r["source_text"]) for r in rows}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        read = readers.masked_sources(spark, paths)
        assert read.rdd.getNumPartitions() > 10
        assert read.select("place.file", "place.block").distinct().count() > 10
        assert {r.id: (r.lang, r.source_text) for r in readers.last_lines(read).collect()} == want
        numbered = readers.numbered_lines(readers.placed_lines(spark, paths["de"])).collect()
        assert [r.value for r in sorted(numbered, key=lambda r: r.line)] == lines["de"] and sorted(r.line for r in numbered) == list(range(len(lines["de"])))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def chat(n=40):
    rng = random.Random(9)
    value = lambda: rng.choice(["a@b.test", "c@d.test", "1.2.3.4", "e@f.test", "5.6.7.8", "plain", "words"])
    return [(c, t, None if rng.random() < 0.05 else " ".join(value() for _ in range(rng.randint(0, 8)))) for c in [*range(n), *[7] * 5] for t in range(rng.randint(1, 5))]


def test_one_mapping_for_a_conversation(spark):
    rules = [Rule("email", "EMAIL_ADDRESS", r"[a-z]+@[a-z]+[.]test"), Rule("ip", "IP_ADDRESS", r"[0-9]+(?:[.][0-9]+){3}")]
    turns = [(c, t, x) for c, t, x in chat()] + [(None, 0, "a@b.test"), (99, 3, "z@z.test 1.2.3.4 z@z.test"), (99, 1, "1.2.3.4 a@b.test")]
    df = spark.createDataFrame([(*t, "k") for t in turns], "conv_id long, turn long, text string, original string")
    done = conversation.redact_conversations(df, rules)
    rows = done.collect()
    assert len(rows) == len(turns) and done.columns == ["conv_id", "turn", "text", "original", "mapping"]
    assert sorted((r.turn, r.text) for r in rows if r.conv_id == 99) == [(1, "<IP_ADDRESS_1> <EMAIL_ADDRESS_1>"), (3, "<EMAIL_ADDRESS_2> <IP_ADDRESS_1> <EMAIL_ADDRESS_2>")]
    back = conversation.restore_conversations(done).select("conv_id", "turn", "text").collect()
    assert sorted(map(str, map(tuple, back))) == sorted(map(str, turns))
    fakes = {}
    for r in rows:
        for m in r.mapping:
            assert fakes.setdefault((r.conv_id, m.fake), m.original) == m.original
    mapped = conversation.mapping_of(conversation.with_spans(df, rules))
    answers = spark.createDataFrame([(99, "send <EMAIL_ADDRESS_2> and <EMAIL_ADDRESS_9>"), (99, None), (5000, "<EMAIL_ADDRESS_1>"), (99, "<IP_ADDRESS_1>")], "conv_id long, text string")
    assert sorted(map(str, map(tuple, conversation.restored_with(answers, mapped).collect()))) == sorted(map(str, [(99, "send z@z.test and <EMAIL_ADDRESS_9>"), (99, None), (5000, "<EMAIL_ADDRESS_1>"), (99, "1.2.3.4")]))
    assert conversation.redact_conversations(df.limit(0), rules).count() == 0


def test_conversation_streams_give_the_batch_result(spark, tmp_path):
    rules = [Rule("email", "EMAIL_ADDRESS", r"[a-z]+@[a-z]+[.]test"), Rule("ip", "IP_ADDRESS", r"[0-9]+(?:[.][0-9]+){3}")]
    turns = sorted({(c, t): (c, t, x) for c, t, x in chat(12)}.values(), key=lambda t: (t[1], t[0]))
    df = spark.createDataFrame(turns, "conv_id long, turn long, text string")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k in range(3):  # batches of turns, in order
            df.filter((F.col("turn") >= 2 * k) & (F.col("turn") < 2 * k + 2)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = redact_conversation_stream(stream, rules).writeStream.format("memory").queryName("talks").outputMode("append").start()
        q.processAllAvailable()
        q.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    key = lambda rows: sorted((r.conv_id, r.turn, str(r.text), [tuple(m) for m in r.mapping]) for r in rows)
    assert key(spark.table("talks").collect()) == key(conversation.redact_conversations(df, rules).collect())


def test_json_lists_in_many_splits(spark, tmp_path):
    """A list in many splits gives the rows of a single task's read, whatever is in its strings."""
    rng = random.Random(7)
    bits = ["}", "{", '"', "\\", "]", "[", "é", "\n", ", ", "text ", '{"a": [1]}', '"]}', "😀"]
    row = lambda i: {"id": str(i), "lang": rng.choice(["de", None]), "text": "".join(rng.choice(bits) for _ in range(rng.randint(0, 60 if i % 97 else 9000))), "expected": {"k}": "V", "x\"{": "W"} if i % 3 else {}, "must_preserve": ["}{", "]"] * rng.randint(0, 2)}
    rows = [row(i) for i in range(900)]
    for name, kept, indent in (("a", rows, None), ("b", rows[:300], 1), ("c", [], None), ("d", [*rows[:5], 7, None, "x{", [1, {"id": "inner"}], rows[5]], 2)):
        (tmp_path / f"{name}.json").write_text(json.dumps(kept, ensure_ascii=rng.random() < 0.5, indent=indent))
    key = lambda df: sorted(str((r.id, r.lang, r.text, r.expected, r.must_preserve)) for r in df.collect())
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for size in ("3000", "100k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "10")
        try:
            for name in "abc":
                path = str(tmp_path / f"{name}.json")
                assert key(json_arrays.read_array(spark, path)) == key(readers.json_array(spark, path)), (name, size)
            if size == "3000":
                assert json_arrays._stretches(spark, str(tmp_path / "a.json")).rdd.getNumPartitions() > 30
            assert sorted(r.id for r in json_arrays.read_array(spark, str(tmp_path / "d.json")).collect()) == sorted(r["id"] for r in rows[:6])
            both = json_arrays.read_array(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")])
            assert both.count() == 1200
        finally:
            for c, v in before.items():
                spark.conf.set(c, v)
    plan = json_arrays.read_array(spark, str(tmp_path / "a.json")).select("id")._jdf.queryExecution().optimizedPlan().toString()
    assert "must_preserve" not in plan
