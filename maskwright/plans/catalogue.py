"""The registered queries over the driver's tables, each with DuckDB SQL that gives the same rows.

Truth is what five patterns find in documents (cards must pass Luhn). Solutions are redactors that know some of the types.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import checksums
from ..functions import text as X
from ..operators import arguments, conversation, dictionary, latency, matching, payload as P, sampling, score, tagger
from ..operators.detect import ALLOWLIST, CARD, EMAIL, IP, PHONE, REGISTRY, SECRET, URL, Rule, default_language, detect
from ..operators.redact import redact, resolve
from ..operators.redact import restore as restored
from ..session import shared_path
from ..sources import readers
from . import reports

TYPES = {"EMAIL_ADDRESS": (EMAIL, 0), "IP_ADDRESS": (IP, 0), "PHONE_NUMBER": (PHONE, 0), "CREDIT_CARD": (CARD, 0), "SECRET": (SECRET, 1)}
#: What a redactor replaces for each type.
MASKS = {t: p for t, (p, _) in TYPES.items()} | {"SECRET": "[0-9a-f]{40}"}
SOLUTIONS = {
    "flat_baseline": ("EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD"),
    "full": tuple(TYPES),
    "light": ("EMAIL_ADDRESS", "IP_ADDRESS"),
    "light_all": ("EMAIL_ADDRESS", "IP_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD"),
}
FLAT_ONLY = ("flat_baseline",)
HOST = r"[a-z0-9]+[.]example[.]com"
LONG_NUMBER = r"[0-9]{10,}"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# --- shared columns and SQL ---------------------------------------------------------------------------------------


#: Literals without which a pattern need not be tried.
GUARDS = {EMAIL: "@", PHONE: "+", SECRET: 'token = "', HOST: ".example.com", IP: "."}


def extracted(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches, in order, with repeats."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.when(F.contains(text, F.lit(GUARDS[pattern])), found).otherwise(F.array().cast("array<string>")) if pattern in GUARDS else found


def values(kind: str, text: Column) -> Column:
    """What the type's pattern finds, in order, with repeats."""
    found = extracted(text, *TYPES[kind])
    return F.filter(found, checksums.luhn) if kind == "CREDIT_CARD" else found


def truth_array(text: Column) -> Column:
    """Distinct struct<type, pii>, sorted: stays in the document's row, so that scoring needs no join."""
    typed = lambda kind: lambda v: F.struct(F.lit(kind).alias("type"), v.alias("pii"))
    each = [F.transform(values(k, text), typed(k)) for k in TYPES]
    return F.array_sort(F.array_distinct(F.flatten(F.array(*each))))


def masked(text: Column, kinds: tuple[str, ...]) -> Column:
    for k in kinds:
        text = F.regexp_replace(text, MASKS[k], f"<{k}>")
    return text


def truth(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "lang", F.explode(truth_array(F.col("text"))).alias("x")).select("doc_id", "lang", "x.type", "x.pii")


def scored(docs: DataFrame, solutions: tuple[str, ...] = tuple(SOLUTIONS)) -> DataFrame:
    """A row for each solution, document and truth value; scan and truth once for all solutions, and each text redacted once
    for each of them."""
    outs = F.array(*(F.struct(F.lit(s).alias("solution"), masked(F.col("text"), SOLUTIONS[s]).alias("out"), F.lit(s in FLAT_ONLY).alias("flat_only")) for s in solutions))
    known = docs.withColumn("truth", truth_array(F.col("text"))).filter("size(truth) > 0")
    per = known.select("doc_id", "lang", "text", "truth", F.explode(outs).alias("o")).select("doc_id", "lang", "truth", "o.solution", "o.out", F.when(F.col("o.flat_only"), F.col("text")).otherwise(F.col("o.out")).alias("inner"))
    per = per.select("solution", "doc_id", "lang", "out", "inner", F.explode("truth").alias("x"))
    return per.select("solution", "doc_id", "lang", F.col("x.type").alias("type"), F.col("x.pii").alias("pii"), (~X.literal_contains(F.col("out"), F.col("x.pii"))).alias("caught"), X.strictly_absent(F.col("x.pii"), F.col("out")).alias("strict"), X.literal_contains(F.col("inner"), F.col("x.pii")).alias("inner_leak"), X.literal_contains(X.ascii_note(F.col("inner")), F.col("x.pii")).alias("ascii_leak"))


#: The masks as rules, for payloads.
MASK_RULES = tuple(Rule(t.lower(), t, p) for t, p in MASKS.items())


def scored_payloads(docs: DataFrame) -> DataFrame:
    """scored(), with tool_leak and mm_leak from payloads that were redacted: each document as a text part and a tool call, searched
    once, redacted by each solution with what it knows. Solutions that know flat text alone leave payloads as they are."""
    known = docs.withColumn("truth", truth_array(F.col("text"))).filter("size(truth) > 0")
    payloads = known.select("doc_id", "lang", "text", "truth", P.combined(F.col("text")).alias("messages"))
    each = F.array(*(F.struct(F.lit(s).alias("solution"), F.array(*map(F.lit, () if s in FLAT_ONLY else SOLUTIONS[s])).cast("array<string>").alias("types"), masked(F.col("text"), SOLUTIONS[s]).alias("out")) for s in SOLUTIONS))
    per = arguments.with_spans(payloads, MASK_RULES).select("doc_id", "lang", "truth", "messages", "__found", F.explode(each).alias("s")).select("doc_id", "lang", "truth", "messages", "__found", "s.*")
    done = arguments.redacted(per, allow="types")
    read = done.select("solution", "doc_id", "lang", "out", F.get_json_object(P.first_arguments(F.col("messages")), "$.note").alias("args"), P.first_multimodal(F.col("messages")).alias("mm"), F.explode("truth").alias("x"))
    pii = F.col("x.pii")
    return read.select("solution", "doc_id", "lang", F.col("x.type").alias("type"), pii.alias("pii"), (~X.literal_contains(F.col("out"), pii)).alias("caught"), X.strictly_absent(pii, F.col("out")).alias("strict"), X.literal_contains(F.col("args"), pii).alias("tool_leak"), X.literal_contains(F.col("mm"), pii).alias("mm_leak"))


LUHN_SQL = "(list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 1 THEN 2 * CAST(substr({v}, CAST(i AS INTEGER), 1) AS INTEGER) - 9 * CAST(CAST(substr({v}, CAST(i AS INTEGER), 1) AS INTEGER) > 4 AS INTEGER) ELSE CAST(substr({v}, CAST(i AS INTEGER), 1) AS INTEGER) END)) % 10 = 0)"


def _values_sql(kind: str) -> str:
    pattern, group = TYPES[kind]
    found = f"regexp_extract_all(text, {_q(pattern)}, {group})"
    return f"list_filter({found}, lambda v: {LUHN_SQL.format(v='v')})" if kind == "CREDIT_CARD" else found


def _truth_sql(columns: str, table: str) -> str:
    return "truth AS (" + " UNION ALL ".join(f"SELECT DISTINCT {columns}, '{k}' AS type, unnest({_values_sql(k)}) AS pii FROM {table}" for k in TYPES) + ")"


TRUTH_SQL = _truth_sql("doc_id, lang", "documents")


def _masked_sql(column: str, kinds: tuple[str, ...]) -> str:
    for k in kinds:
        column = f"regexp_replace({column}, {_q(MASKS[k])}, '<{k}>', 'g')"
    return column


ASCII_SQL = "list_aggregate(list_transform(string_split(CAST(json_object('note', {x}) AS VARCHAR), ''), lambda c: CASE WHEN unicode(c) < 128 THEN c WHEN unicode(c) < 65536 THEN '\\u' || lpad(lower(to_hex(unicode(c))), 4, '0') ELSE '\\u' || lower(to_hex(55296 + ((unicode(c) - 65536) // 1024))) || '\\u' || lower(to_hex(56320 + ((unicode(c) - 65536) % 1024))) END), 'string_agg', '')"
TOKENS_SQL = r"regexp_extract_all(pii, '([\p{L}\p{N}_]{4,})', 1)"


def _scored_sql(*solutions: str, ascii: bool = False) -> str:
    outs = " UNION ALL ".join(f"SELECT '{s}' AS solution, doc_id, {_masked_sql('text', SOLUTIONS[s])} AS out, {_masked_sql('text', SOLUTIONS[s]) if s not in FLAT_ONLY else 'text'} AS inner_text FROM documents WHERE doc_id IN (SELECT doc_id FROM truth)" for s in solutions)
    wide = f"SELECT *, {ASCII_SQL.format(x='inner_text')} AS ascii_text FROM outs" if ascii else "SELECT * FROM outs"
    return f"""WITH {TRUTH_SQL}, outs AS ({outs}), wide AS ({wide}), scored AS (
  SELECT solution, doc_id, lang, type, pii, NOT contains(out, pii) AS caught,
    CASE WHEN len({TOKENS_SQL}) = 0 THEN NOT contains(out, pii) ELSE len(list_filter({TOKENS_SQL}, lambda t: contains(out, t))) = 0 END AS strict,
    contains(inner_text, pii) AS inner_leak{', contains(ascii_text, pii) AS ascii_leak' if ascii else ''}
  FROM truth JOIN wide USING (doc_id))
"""


SCORED_SQL = _scored_sql(*SOLUTIONS)
LIGHT_SQL = f"""WITH {TRUTH_SQL}, outs AS (SELECT doc_id, {_masked_sql('text', SOLUTIONS['light'])} AS out FROM documents),
scored AS (SELECT doc_id, lang, type, pii, NOT contains(out, pii) AS caught FROM truth JOIN outs USING (doc_id))
"""


def _n(c: str) -> Column:
    return F.count_if(F.col(c)).cast("long")


def percent(part: Column, all_of: Column) -> Column:
    return score.rate(part, all_of, percent=True)


def _pct(part: str, all_of: str = "count(*)") -> str:
    return f"CASE WHEN {all_of} > 0 THEN {part} * 100.0::DOUBLE / {all_of} ELSE 0.0::DOUBLE END"


def _c(c: str) -> str:
    return f"count(*) FILTER ({c})"


# --- flagship -----------------------------------------------------------------------------------------------------


@query(LIGHT_SQL + f"SELECT lang, type, count(*) AS total, {_c('caught')} AS caught, {_pct(_c('caught'))} AS recall FROM scored GROUP BY lang, type")
def flagship_recall(spark, d):
    """Recall of the light redactor by language and type."""
    s = scored(_t(spark, d, "documents"), ("light",))
    return s.groupBy("lang", "type").agg(F.count("*").alias("total"), _n("caught").alias("caught"), percent(_n("caught"), F.count("*")).alias("recall"))


# --- detection ----------------------------------------------------------------------------------------------------


def _detections(spark, d, rule: Rule, text: str = "text") -> DataFrame:
    """text: an expression over documents, for kinds of values that the tables lack."""
    spans = detect(F.col("text"), [rule])
    return _t(spark, d, "documents").select("doc_id", F.expr(text).alias("text")).select("doc_id", F.posexplode(spans).alias("ord", "s")).select("doc_id", F.col("ord").cast("long").alias("ord"), F.col("s.text").alias("pii"), F.col("s.start").cast("long").alias("start"))


def _detect_sql(pattern: str, group: int = 0, lead: int = 0, where: str = "TRUE", text: str = "text") -> str:
    """Starts from the lengths of pieces and matches before; lead: length of what stands before the group."""
    return f"""WITH m AS (SELECT doc_id, regexp_extract_all(text, {_q(pattern)}, 0) AS w, regexp_extract_all(text, {_q(pattern)}, {group}) AS v, string_split_regex(text, {_q(pattern.replace('(', '(?:', 1) if group else pattern)}) AS p FROM (SELECT doc_id, {text} AS text FROM documents)),
k AS (SELECT doc_id, unnest(range(1, len(v) + 1)) AS k, w, v, p FROM m WHERE len(v) > 0),
f AS (SELECT doc_id, k, v[k] AS pii, CAST(list_sum(list_transform(p[1:k], lambda x: len(x))) + coalesce(list_sum(list_transform(w[1:k-1], lambda x: len(x))), 0) + {lead} AS BIGINT) AS start FROM k)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS ord, pii, start FROM f WHERE {where}"""


@query(_detect_sql(EMAIL))
def detect_email(spark, d):
    return _detections(spark, d, Rule("email", "EMAIL_ADDRESS", EMAIL, guard="@"))


@query(_detect_sql(IP, where="len(list_filter(string_split(pii, '.'), lambda x: CAST(x AS INTEGER) > 255)) = 0"))
def detect_ip(spark, d):
    return _detections(spark, d, Rule("ip", "IP_ADDRESS", IP, valid=checksums.octets))


@query(_detect_sql(PHONE))
def detect_phone(spark, d):
    return _detections(spark, d, Rule("phone", "PHONE_NUMBER", PHONE, guard="+"))


@query(_detect_sql(SECRET, 1, len('token = "')))
def detect_secret(spark, d):
    return _detections(spark, d, Rule("secret", "SECRET", SECRET, 1, guard='token = "'))


@query(_detect_sql(CARD, where=LUHN_SQL.format(v="pii")))
def detect_card_luhn(spark, d):
    return _detections(spark, d, Rule("card", "CREDIT_CARD", CARD, valid=checksums.luhn))


# Values of the kinds below are made from doc_id, good and bad ones, by expressions that both engines know.
_DIGITS = "lpad(CAST(doc_id AS VARCHAR(20)), 18, '0')"
_IBAN_CHECK = f"(98 - CAST(concat({_DIGITS}, '131400') AS DECIMAL(38, 0)) % 97 + doc_id % 3) % 98"
IBAN_TEXT = f"concat(text, ' to DE', lpad(CAST(CAST({_IBAN_CHECK} AS INTEGER) AS VARCHAR(9)), 2, '0'), {_DIGITS}, ' now')"
SSN_TEXT = "concat(text, ' ssn ', lpad(CAST(doc_id * 37 % 1000 AS VARCHAR(9)), 3, '0'), '-', lpad(CAST(doc_id % 50 AS VARCHAR(9)), 2, '0'), '-', lpad(CAST(doc_id % 10000 AS VARCHAR(9)), 4, '0'), '.')"
_NHS = "lpad(CAST(doc_id * 7919 % 1000000000 AS VARCHAR(20)), 9, '0')"
_NHS_SUM = " + ".join(f"CAST(substr({_NHS}, {i}, 1) AS INTEGER) * {11 - i}" for i in range(1, 10))
NHS_TEXT = f"concat(text, ' nhs ', substr({_NHS}, 1, 3), ' ', substr({_NHS}, 4, 3), ' ', substr({_NHS}, 7, 3), CAST((11 - ({_NHS_SUM}) % 11 + doc_id % 2) % 11 % 10 AS VARCHAR(9)), '.')"
DATE_TEXT = "concat(text, ' on 2024-0', CAST(doc_id % 9 + 1 AS VARCHAR(9)), '-1', CAST(doc_id % 10 AS VARCHAR(9)), ' or ', CAST(doc_id % 28 + 1 AS VARCHAR(9)), CASE WHEN doc_id % 2 = 0 THEN '/' ELSE '.' END, '7.1999')"
_PLAIN = "replace(pii, ' ', '')"


@query(_detect_sql(REGISTRY["iban"].pattern, text=IBAN_TEXT, where=f"length({_PLAIN}) >= 15 AND list_reduce(list_concat([0], list_transform(string_split(substr({_PLAIN}, 5) || substr({_PLAIN}, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN CAST(ascii(c) - 48 AS INTEGER) ELSE CAST(ascii(c) - 55 AS INTEGER) END)), lambda a, x: (a * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97) = 1"))
def detect_iban(spark, d):
    return _detections(spark, d, REGISTRY["iban"], IBAN_TEXT)


@query(_detect_sql(REGISTRY["ssn"].pattern, text=SSN_TEXT, where="substr(pii, 1, 3) NOT IN ('000', '666') AND pii[1] <> '9' AND substr(pii, 5, 2) <> '00' AND substr(pii, 8) <> '0000'"))
def detect_ssn(spark, d):
    return _detections(spark, d, REGISTRY["ssn"], SSN_TEXT)


@query(_detect_sql(REGISTRY["nhs"].pattern, text=NHS_TEXT, where="(11 - list_sum(list_transform(range(1, 10), lambda i: CAST(substr(replace(pii, ' ', ''), CAST(i AS INTEGER), 1) AS INTEGER) * (11 - i))) % 11) % 11 = CAST(pii[-1] AS INTEGER)"))
def detect_nhs(spark, d):
    return _detections(spark, d, REGISTRY["nhs"], NHS_TEXT)


@query(_detect_sql(REGISTRY["date"].pattern, text=DATE_TEXT))
def detect_date(spark, d):
    return _detections(spark, d, REGISTRY["date"], DATE_TEXT)


@query(f"WITH u AS (SELECT page_id, regexp_extract_all(url || ' ' || html, {_q(URL)}, 0) AS v FROM pages) SELECT page_id, unnest(range(0, len(v))) AS ord, unnest(v) AS url FROM u WHERE len(v) > 0")
def detect_url(spark, d):
    found = F.regexp_extract_all(F.concat("url", F.lit(" "), "html"), F.lit(URL), F.lit(0))
    return _t(spark, d, "pages").select("page_id", F.posexplode(found).alias("ord", "url")).withColumn("ord", F.col("ord").cast("long"))


@query("SELECT d.doc_id, b.item_id, CAST(len(string_split(d.text, b.text)) - 1 AS BIGINT) AS n_hits FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE b.text <> ''")
def dictionary_hits(spark, d):
    return dictionary.hits(_t(spark, d, "documents"), _t(spark, d, "benchmark")).select("doc_id", "item_id", "n_hits")


@query("""WITH h AS (SELECT d.doc_id, b.item_id, len(b.text) AS n, string_split(d.text, b.text) AS p FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE b.text <> ''),
k AS (SELECT *, unnest(range(1, len(p))) AS k FROM h) SELECT doc_id, item_id, CAST(list_sum(list_transform(p[1:k], lambda x: len(x))) + (k - 1) * n AS BIGINT) AS start FROM k""")
def dictionary_offsets(spark, d):
    return dictionary.hits(_t(spark, d, "documents"), _t(spark, d, "benchmark")).select("doc_id", "item_id", F.explode("starts").alias("start"))


@query(f"WITH {TRUTH_SQL} SELECT * FROM truth")
def truth_explode(spark, d):
    return truth(_t(spark, d, "documents"))


# --- leaks and recall ---------------------------------------------------------------------------------------------


@query(LIGHT_SQL + "SELECT doc_id, type, pii, NOT caught AS leaked FROM scored")
def leak_predicate(spark, d):
    return scored(_t(spark, d, "documents"), ("light",)).select("doc_id", "type", "pii", (~F.col("caught")).alias("leaked"))


@query(SCORED_SQL + f"SELECT solution, count(*) AS expected, {_c('caught')} AS detected, CASE WHEN count(*) > 0 THEN {_c('caught')}::DOUBLE / count(*) ELSE 0.0 END AS detection_rate FROM scored GROUP BY solution")
def detection_rate(spark, d):
    return scored(_t(spark, d, "documents")).groupBy("solution").agg(F.count("*").alias("expected"), _n("caught").alias("detected"), score.rate(_n("caught"), F.count("*")).alias("detection_rate"))


@query(SCORED_SQL + f"SELECT solution, {_c('NOT caught')} AS missed, CASE WHEN count(*) > 0 THEN {_c('NOT caught')}::DOUBLE / count(*) ELSE 0.0 END AS miss_rate FROM scored GROUP BY solution")
def miss_rate(spark, d):
    missed = F.count_if(~F.col("caught")).cast("long")
    return scored(_t(spark, d, "documents")).groupBy("solution").agg(missed.alias("missed"), score.rate(missed, F.count("*")).alias("miss_rate"))


def _recall(spark, d, *by: str, what: str = "caught") -> DataFrame:
    return scored(_t(spark, d, "documents")).groupBy("solution", *by).agg(F.count("*").alias("total"), _n(what).alias("caught"), percent(_n(what), F.count("*")).alias("recall"))


def _recall_sql(*by: str, what: str = "caught") -> str:
    keys = ", ".join(("solution", *by))
    return SCORED_SQL + f"SELECT {keys}, count(*) AS total, {_c(what)} AS caught, {_pct(_c(what))} AS recall FROM scored GROUP BY {keys}"


@query(_recall_sql("lang"))
def recall_by_lang(spark, d):
    return _recall(spark, d, "lang")


@query(_recall_sql("type"))
def recall_by_type(spark, d):
    return _recall(spark, d, "type")


@query(_recall_sql(what="strict"))
def recall_strict(spark, d):
    return _recall(spark, d, what="strict")


@query(SCORED_SQL + f"SELECT solution, lang, type, count(*) AS total, {_c('caught')} AS caught, {_pct(_c('caught'))} AS recall FROM scored GROUP BY GROUPING SETS ((solution), (solution, lang), (solution, type))")
def recall_grouping_sets(spark, d):
    aggregates = {"total": "count(*)", "caught": "count_if(caught)", "recall": "CASE WHEN count(*) > 0 THEN count_if(caught) * 100.0D / count(*) ELSE 0.0D END"}
    return score.grouping_sets(scored(_t(spark, d, "documents")), aggregates, [("solution",), ("solution", "lang"), ("solution", "type")])


@query(SCORED_SQL + "SELECT solution, " + ", ".join(f"CASE WHEN count(*) FILTER (type = '{k}') > 0 THEN count(*) FILTER (type = '{k}' AND caught) * 100.0::DOUBLE / count(*) FILTER (type = '{k}') ELSE 0.0::DOUBLE END AS {k}" for k in TYPES) + " FROM scored GROUP BY solution")
def recall_pivot(spark, d):
    """Types as columns, a fixed list, so that no job looks for them; absent ones are 0."""
    return scored(_t(spark, d, "documents")).groupBy("solution").pivot("type", list(TYPES)).agg(percent(_n("caught"), F.count(F.lit(1)))).na.fill(0.0)


@query(SCORED_SQL + f"SELECT solution, count(*) AS total, {_c('caught')} AS caught, {_c('strict')} AS strict_caught, {_pct(_c('caught'))} AS recall, {_pct(_c('strict'))} AS recall_strict, {_pct(_c('inner_leak'))} AS tool_leak, {_pct(_c('inner_leak'))} AS mm_leak, {_pct(_c('caught AND NOT inner_leak'), _c('caught'))} AS tool_protection FROM scored GROUP BY solution")
def solution_compare(spark, d):
    safe = F.count_if(F.col("caught") & ~F.col("tool_leak"))
    return scored_payloads(_t(spark, d, "documents")).groupBy("solution").agg(F.count("*").alias("total"), _n("caught").alias("caught"), _n("strict").alias("strict_caught"), percent(_n("caught"), F.count("*")).alias("recall"), percent(_n("strict"), F.count("*")).alias("recall_strict"), percent(_n("tool_leak"), F.count("*")).alias("tool_leak"), percent(_n("mm_leak"), F.count("*")).alias("mm_leak"), percent(safe, _n("caught")).alias("tool_protection"))


def _leak_query(name: str, column: str):
    sql = _scored_sql(*SOLUTIONS, ascii=column == "ascii_leak") + f"SELECT solution, {_c(column)} AS leaked, {_pct(_c(column))} AS {name} FROM scored GROUP BY solution"

    def run(spark, d):
        rows = scored(_t(spark, d, "documents")) if column == "ascii_leak" else scored_payloads(_t(spark, d, "documents")).withColumn(column, F.col(name))
        return rows.groupBy("solution").agg(_n(column).alias("leaked"), percent(_n(column), F.count("*")).alias(name))

    run.__name__ = name
    query(sql)(run)


_leak_query("tool_leak", "inner_leak")
_leak_query("tool_leak_ascii", "ascii_leak")
_leak_query("mm_leak", "inner_leak")


@query(SCORED_SQL + f"SELECT solution, {_c('caught')} AS caught, {_c('caught AND NOT inner_leak')} AS protected, {_pct(_c('caught AND NOT inner_leak'), _c('caught'))} AS tool_protection FROM scored GROUP BY solution")
def tool_protection(spark, d):
    safe = F.count_if(F.col("caught") & ~F.col("tool_leak")).cast("long")
    return scored_payloads(_t(spark, d, "documents")).groupBy("solution").agg(_n("caught").alias("caught"), safe.alias("protected"), percent(safe, _n("caught")).alias("tool_protection"))


# --- false positives on clean documents ---------------------------------------------------------------------------

CLEAN_SQL = f"WITH {TRUTH_SQL}, clean AS (SELECT doc_id, regexp_extract_all(text, '{LONG_NUMBER}', 0) AS found FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM truth)) "


def _clean(spark, d) -> DataFrame:
    docs = _t(spark, d, "documents").filter(F.size(truth_array(F.col("text"))) == 0)
    return docs.select("doc_id", F.regexp_extract_all("text", F.lit(LONG_NUMBER), F.lit(0)).alias("found"))


@query(CLEAN_SQL + "SELECT count(*) AS clean_docs, CAST(sum(len(found)) AS BIGINT) AS entities, CASE WHEN count(*) > 0 THEN CAST(sum(len(found)) AS DOUBLE) / count(*) ELSE 0.0 END AS fp_rate FROM clean")
def fp_clean_entities(spark, d):
    n = F.sum(F.size("found")).cast("long")
    return _clean(spark, d).agg(F.count("*").alias("clean_docs"), n.alias("entities"), score.rate(n, F.count("*")).alias("fp_rate"))


@query(CLEAN_SQL + f"SELECT count(*) AS clean_docs, {_c('len(found) > 0')} AS flagged, {_pct(_c('len(found) > 0'))} AS fp_percent FROM clean")
def fp_clean_docs(spark, d):
    n = F.count_if(F.size("found") > 0).cast("long")
    return _clean(spark, d).agg(F.count("*").alias("clean_docs"), n.alias("flagged"), percent(n, F.count("*")).alias("fp_percent"))


@query(CLEAN_SQL + "SELECT CAST(sum(len(list_distinct(found))) AS BIGINT) AS distinct_originals FROM clean")
def fp_distinct_originals(spark, d):
    return _clean(spark, d).agg(F.sum(F.size(F.array_distinct("found"))).cast("long").alias("distinct_originals"))


# --- matching -----------------------------------------------------------------------------------------------------


def _matched(spark, d) -> DataFrame:
    """Expected values against what a wider detector finds (hosts too), both sorted; documents with either."""
    detected = F.array_sort(F.array_distinct(F.flatten(F.array(*(extracted(F.col("text"), p) for p in (EMAIL, HOST, IP, CARD))))))
    docs = _t(spark, d, "documents").select("doc_id", "lang", F.array_sort(F.array_distinct(F.transform(truth_array(F.col("text")), lambda x: x["pii"]))).alias("expected"), detected.alias("detected"))
    docs = docs.filter("size(expected) > 0 or size(detected) > 0")
    return docs.withColumn("m", score.greedy_match(F.col("detected"), F.col("expected"))).select("doc_id", "lang", "expected", "detected", "m.*")


_OVERLAP = "(contains(lower(trim({a})), lower(trim({b}))) OR contains(lower(trim({b})), lower(trim({a}))))"
MATCH_SQL = f"""WITH RECURSIVE {TRUTH_SQL}, d AS (
  SELECT doc_id, lang, list_sort(list_distinct(list_concat(regexp_extract_all(text, {_q(EMAIL)}, 0), regexp_extract_all(text, {_q(HOST)}, 0), regexp_extract_all(text, {_q(IP)}, 0), regexp_extract_all(text, {_q(CARD)}, 0)))) AS detected FROM documents),
e AS (SELECT doc_id, list_sort(list(DISTINCT pii)) AS expected FROM truth GROUP BY doc_id),
b AS (SELECT d.doc_id, d.lang, coalesce(expected, []::VARCHAR[]) AS expected, detected FROM d LEFT JOIN e USING (doc_id) WHERE len(detected) > 0 OR len(coalesce(expected, []::VARCHAR[])) > 0),
r AS (
  SELECT doc_id, 0 AS i, []::BIGINT[] AS used, []::VARCHAR[] AS fp FROM b
  UNION ALL
  SELECT doc_id, i + 1, CASE WHEN len(free) > 0 THEN list_append(used, free[1]) ELSE used END, CASE WHEN len(free) > 0 THEN fp ELSE list_append(fp, x) END FROM (
    SELECT r.doc_id, r.i, r.used, r.fp, b.detected[r.i + 1] AS x, list_filter(range(1, len(b.expected) + 1), lambda k: NOT list_contains(r.used, k) AND {_OVERLAP.format(a='b.detected[r.i + 1]', b='b.expected[k]')}) AS free
    FROM r JOIN b USING (doc_id) WHERE r.i < len(b.detected)) t),
m AS (SELECT b.*, CAST(len(used) AS BIGINT) AS tp, list_transform(used, lambda k: expected[k]) AS matched, fp, list_transform(list_filter(range(1, len(expected) + 1), lambda k: NOT list_contains(used, k)), lambda k: expected[k]) AS fn FROM r JOIN b USING (doc_id) WHERE i = len(detected))
"""


@query(MATCH_SQL + "SELECT doc_id, tp, array_to_string(matched, '|') AS matched, array_to_string(fp, '|') AS fp, array_to_string(fn, '|') AS fn FROM m")
def greedy_match(spark, d):
    return _matched(spark, d).select("doc_id", "tp", *(F.array_join(c, "|").alias(c) for c in ("matched", "fp", "fn")))


_PRF = "tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0 END AS recall"


def _prf_sql(by: str) -> str:
    keys = f"{by}, " if by else ""
    return MATCH_SQL + f", s AS (SELECT {keys}CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(len(fp)) AS BIGINT) AS fp, CAST(sum(len(fn)) AS BIGINT) AS fn FROM m {'GROUP BY ' + by if by else ''}), p AS (SELECT {keys}{_PRF} FROM s) SELECT *, CASE WHEN precision + recall > 0 THEN precision * 2 * recall / (precision + recall) ELSE 0.0 END AS f1 FROM p"


def _counts(spark, d) -> DataFrame:
    return _matched(spark, d).select("lang", "tp", F.size("fp").alias("fp"), F.size("fn").alias("fn"))


@query(_prf_sql(""))
def prf_global(spark, d):
    return score.precision_recall(_counts(spark, d))


@query(_prf_sql("lang"))
def prf_by_lang(spark, d):
    return score.precision_recall(_counts(spark, d), "lang")


@query(MATCH_SQL + "SELECT doc_id, unnest(fn) AS item FROM m")
def fn_items(spark, d):
    return _matched(spark, d).select("doc_id", F.explode("fn").alias("item"))


@query(MATCH_SQL + "SELECT doc_id, unnest(fp) AS item FROM m")
def fp_items(spark, d):
    return _matched(spark, d).select("doc_id", F.explode("fp").alias("item"))


def _overlaps(spark, d, test) -> DataFrame:
    n = F.size(F.filter("expected", lambda e: F.exists("detected", lambda x: test(e, x)))).cast("long")
    return _matched(spark, d).select("doc_id", F.size("expected").cast("long").alias("expected"), n.alias("overlapped"))


def _overlap_sql(test: str) -> str:
    return MATCH_SQL + f"SELECT doc_id, CAST(len(expected) AS BIGINT) AS expected, CAST(len(list_filter(expected, lambda e: len(list_filter(detected, lambda x: {test})) > 0)) AS BIGINT) AS overlapped FROM b"


@query(_overlap_sql("contains(e, x) OR contains(x, e)"))
def overlap_exact(spark, d):
    return _overlaps(spark, d, X.overlap_exact)


@query(_overlap_sql(_OVERLAP.format(a="e", b="x")))
def overlap_folded(spark, d):
    return _overlaps(spark, d, X.overlap_folded)


@query(MATCH_SQL + """, g AS (SELECT b.*, coalesce(l.quality, -1) AS quality FROM b LEFT JOIN labels l USING (doc_id)),
q AS (SELECT quality, CAST(sum(len(expected)) AS BIGINT) AS gold, CAST(sum(len(list_filter(expected, lambda e: len(list_filter(detected, lambda x: contains(e, x) OR contains(x, e))) > 0))) AS BIGINT) AS recovered, CAST(sum(len(detected)) AS BIGINT) AS labels, CAST(sum(len(list_filter(detected, lambda x: len(list_filter(expected, lambda e: contains(e, x) OR contains(x, e))) > 0))) AS BIGINT) AS overlapping FROM g GROUP BY quality)
SELECT CAST(quality AS INTEGER) AS quality, gold, recovered, labels, overlapping, CASE WHEN gold > 0 THEN recovered * 100.0::DOUBLE / gold END AS recovered_percent, CASE WHEN labels > 0 THEN overlapping * 100.0::DOUBLE / labels END AS overlap_percent FROM q""")
def label_quality(spark, d):
    """Gold values that some label overlaps, and labels that overlap some gold value; null percent for nothing to count."""
    joined = _matched(spark, d).join(_t(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").withColumn("quality", F.coalesce("quality", F.lit(-1)))
    n = lambda c, name: F.sum(c).cast("long").alias(name)
    sums = joined.groupBy("quality").agg(n(F.size("expected"), "gold"), n(score.recovered(F.col("expected"), F.col("detected")), "recovered"), n(F.size("detected"), "labels"), n(score.recovered(F.col("detected"), F.col("expected")), "overlapping"))
    return sums.withColumns({"recovered_percent": score.rate_or_null(F.col("recovered"), F.col("gold")), "overlap_percent": score.rate_or_null(F.col("overlapping"), F.col("labels"))})


@query("SELECT l.doc_id, l.quality, l.toxic, d.lang, CAST(length(d.text) AS BIGINT) AS n FROM labels l JOIN documents d USING (doc_id)")
def label_text_join(spark, d):
    return _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "lang", "text"), "doc_id").select("doc_id", "quality", "toxic", "lang", F.length("text").cast("long").alias("n"))


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def label_left_default(spark, d):
    return _t(spark, d, "documents").select("doc_id").join(_t(spark, d, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


# --- payloads -----------------------------------------------------------------------------------------------------


@query("SELECT doc_id, md5(text || chr(10)) AS digest, CAST(length(text) AS BIGINT) AS n FROM documents")
def carrier_multimodal(spark, d):
    wrapped = P.wrap(F.col("text"), "multimodal")
    return _t(spark, d, "documents").select("doc_id", F.md5(F.concat(P.flatten(wrapped), F.lit("\n"))).alias("digest"), F.length(P.flatten(wrapped)).cast("long").alias("n"))


@query("SELECT doc_id, md5(CAST(json_object('note', text) AS VARCHAR)) AS digest FROM documents")
def carrier_tool(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(P.first_arguments(P.wrap(F.col("text"), "tool_call"))).alias("digest"))


@query("SELECT doc_id, md5(CAST(json_object('user', json_object('profile', json_object('bio', text)), 'tags', json_array(text)) AS VARCHAR)) AS digest FROM documents")
def carrier_nested(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(P.first_arguments(P.wrap(F.col("text"), "tool_call_nested"))).alias("digest"))


@query(f"SELECT doc_id, md5(text || chr(10) || {ASCII_SQL.format(x='text')}) AS digest FROM documents")
def carrier_combined(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(P.flatten(P.combined(F.col("text")))).alias("digest"))


@query("SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN CAST(json_object('note', text) AS VARCHAR) ELSE text END AS flat, CAST(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS BIGINT) AS calls FROM conversations")
def flatten_messages(spark, d):
    """Each message as a request: assistants call a tool, others write text."""
    m = F.when(F.col("role") == "assistant", P.wrap(F.col("text"), "tool_call")).otherwise(P.wrap(F.col("text"), "flat"))
    return _t(spark, d, "conversations").select("conv_id", "turn", P.flatten(m).alias("flat"), F.size(P.tool_calls(m)).cast("long").alias("calls"))


LIGHT = (Rule("email", "EMAIL_ADDRESS", EMAIL, guard="@"), Rule("ip", "IP_ADDRESS", IP))


def _parity(spark, d) -> DataFrame:
    """doc_id, carrier, truth, leaked, flat_leaked: the light redactor on every carrier, a payload each."""
    docs = _t(spark, d, "documents").withColumn("truth", F.transform(truth_array(F.col("text")), lambda x: x["pii"])).filter("size(truth) > 0")
    each = F.array(*(F.struct(F.lit(c).alias("carrier"), P.wrap(F.col("text"), c).alias("messages")) for c in P.CARRIERS))
    payloads = docs.select("doc_id", "truth", F.explode(each).alias("c")).select("doc_id", "truth", "c.*")
    done = arguments.redact_payloads(payloads, LIGHT).select("doc_id", "truth", "carrier", P.flatten(F.col("messages")).alias("out"))
    seen = done.select("doc_id", "truth", "carrier", F.filter("truth", lambda v: X.literal_contains(F.col("out"), v)).alias("leaked"))
    flat = F.max(F.when(F.col("carrier") == "flat", F.col("leaked"))).over(Window.partitionBy("doc_id"))  # four rows of a document
    return seen.withColumn("flat_leaked", flat)


_LIGHT_OUT = _masked_sql("text", SOLUTIONS["light"])
PARITY_SQL = f"""WITH {TRUTH_SQL}, o AS (SELECT doc_id, {_LIGHT_OUT} AS out FROM documents), c AS (SELECT unnest(['flat', 'multimodal', 'tool_call', 'tool_call_nested']) AS carrier), p AS (
  SELECT carrier, doc_id, pii, contains(CASE carrier WHEN 'tool_call' THEN CAST(json_object('note', out) AS VARCHAR) WHEN 'tool_call_nested' THEN CAST(json_object('user', json_object('profile', json_object('bio', out)), 'tags', json_array(out)) AS VARCHAR) ELSE out END, pii) AS leaked, contains(out, pii) AS flat_leaked
  FROM truth JOIN o USING (doc_id), c)
"""


@query(PARITY_SQL + f"SELECT carrier, count(*) AS labels, {_c('leaked')} AS leaked, {_c('NOT leaked')} AS anonymized, {_c('leaked AND NOT flat_leaked')} AS regressions FROM p GROUP BY carrier")
def carrier_parity(spark, d):
    n = lambda e, name: F.sum(e).cast("long").alias(name)
    return _parity(spark, d).groupBy("carrier").agg(n(F.size("truth"), "labels"), n(F.size("leaked"), "leaked"), n(F.size("truth") - F.size("leaked"), "anonymized"), n(F.size(F.array_except("leaked", "flat_leaked")), "regressions"))


@query(PARITY_SQL + "SELECT carrier, doc_id, pii FROM p WHERE leaked AND NOT flat_leaked")
def carrier_regressions(spark, d):
    """What a carrier leaks and flat text does not: no rows."""
    return _parity(spark, d).select("carrier", "doc_id", F.explode(F.array_except("leaked", "flat_leaked")).alias("pii"))


@query(f"WITH {TRUTH_SQL}, ips AS (SELECT DISTINCT doc_id, 'IP_ADDRESS' AS type, unnest(regexp_extract_all(text, {_q(IP)}, 0)) AS pii FROM documents), m AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, type, pii FROM truth WHERE type = 'EMAIL_ADDRESS' UNION SELECT * FROM ips) GROUP BY doc_id) SELECT doc_id, coalesce(n, 0) AS n_fakes, TRUE AS lossless, md5(text) AS restored, md5(text) <> md5({_LIGHT_OUT}) AS changed FROM documents LEFT JOIN m USING (doc_id)")
def roundtrip_restore(spark, d):
    r = F.col("r")
    docs = _t(spark, d, "documents").withColumn("r", redact(F.col("text"), detect(F.col("text"), LIGHT)))
    return docs.select("doc_id", F.size(r["mapping"]).cast("long").alias("n_fakes"), (restored(r["text"], r["mapping"]) == F.col("text")).alias("lossless"), F.md5(restored(r["text"], r["mapping"])).alias("restored"), (r["text"] != F.col("text")).alias("changed"))


@query("WITH f AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS type, v[i] AS original, i FROM (SELECT doc_id, v, unnest(range(1, len(v) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, {_q(MASKS[k])}, 0) AS v FROM documents))" for k in SOLUTIONS["light"]) + "), g AS (SELECT doc_id, type, original, min(i) AS i FROM f GROUP BY ALL) SELECT doc_id, type, original, '<' || type || '_' || row_number() OVER (PARTITION BY doc_id, type ORDER BY i) || '>' AS fake FROM g")
def placeholder_mapping(spark, d):
    r = redact(F.col("text"), detect(F.col("text"), LIGHT))
    return _t(spark, d, "documents").select("doc_id", F.explode(r["mapping"]).alias("m")).select("doc_id", "m.type", "m.original", "m.fake")


@query(rf"""WITH {TRUTH_SQL}, g AS (SELECT doc_id, list(pii) AS v FROM truth GROUP BY doc_id),
o AS (SELECT doc_id, {_LIGHT_OUT} AS out, coalesce(v, []::VARCHAR[]) AS v, unnest(list_distinct(regexp_extract_all(text, '([\p{{L}}\p{{N}}_]{{4,}})', 1))) AS t FROM documents LEFT JOIN g USING (doc_id)),
lost AS (SELECT DISTINCT doc_id FROM o WHERE NOT contains(out, t) AND len(list_filter(v, lambda x: contains(x, t))) = 0)
SELECT doc_id, doc_id NOT IN (SELECT doc_id FROM lost) AS preserved FROM documents""")
def must_preserve(spark, d):
    """Over-redaction guard: every word token of the whole text that is not part of a truth value survives the light
    redactor."""
    values = F.transform(truth_array(F.col("text")), lambda x: x["pii"])
    # tokens of the output are there; only the others are looked for
    missing = lambda x: F.array_except(X.word_tokens(F.col("text")), X.word_tokens(x["out"]))
    of = lambda x: F.filter(missing(x), lambda t: ~F.contains(x["out"], t) & ~F.exists(x["values"], lambda v: F.contains(v, t)))
    lost = X.let(F.struct(values.alias("values"), masked(F.col("text"), SOLUTIONS["light"]).alias("out")), of)
    return _t(spark, d, "documents").select("doc_id", (F.size(lost) == 0).alias("preserved"))


# --- sampling, lookups, counts --------------------------------------------------------------------------------------


@query("WITH q AS (SELECT doc_id, lang FROM documents WHERE length(text) BETWEEN 150 AND 1200), w AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS rn, count(*) OVER (PARTITION BY lang) AS n FROM q) SELECT doc_id, lang FROM w WHERE rn % greatest(1, n // 30) = 0 AND rn // greatest(1, n // 30) < 30")
def even_sample(spark, d):
    docs = _t(spark, d, "documents").filter(F.length("text").between(150, 1200)).select("doc_id", "lang")
    return sampling.even_sample(docs, 30, "lang", F.col("doc_id"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def last_wins_dedup(spark, d):
    return sampling.last_wins(_t(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def first_wins_lookup(spark, d):
    return sampling.first_wins(_t(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda w: w <> '')) * 4 // 3 AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


def _latency_sql(by: str) -> str:
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"WITH g AS (SELECT {keys}list_sort(list(value)) AS v, count(value) AS n, min(value) AS lo, max(value) AS hi, quantile_cont(value, 0.5) AS mid, avg(value) AS mean FROM events WHERE value IS NOT NULL {group}) SELECT {keys}n, lo AS min, mid AS p50, v[least(n * 95 // 100, n - 1) + 1] AS p95, v[least(n * 99 // 100, n - 1) + 1] AS p99, hi AS max, round(mean, 6) AS mean FROM g"


@query(_latency_sql(""))
def latency_stats(spark, d):
    return latency.statistics(_t(spark, d, "events"), "value").withColumn("mean", F.round("mean", 6))


@query(_latency_sql("event_type"))
def latency_by_group(spark, d):
    return latency.statistics(_t(spark, d, "events"), "value", "event_type").withColumn("mean", F.round("mean", 6))


CONFIGS = {"1": ["fr"], "2": ["fr", "en"], "3": ["fr", "en", "de"], "5": ["fr", "en", "de", "es", "it"], "7": ["fr", "en", "de", "es", "it", "nl", "pt"]}
_CONFIG_SQL = " UNION ALL ".join(f"SELECT '{k}' AS config, {v!r} AS langs" for k, v in CONFIGS.items())


@query(f"WITH c AS ({_CONFIG_SQL}) SELECT config, lang, array_to_string(list_concat([lang], list_filter(langs, lambda x: x <> lang)), ',') AS tried, count(*) AS docs FROM documents, c WHERE list_contains(langs, lang) GROUP BY ALL")
def lang_config_applicability(spark, d):
    """Documents that each language configuration covers, with the languages in the order tried. The five configurations
    are literals in the row, not a join."""
    from ..operators.detect import first_language

    every = F.array(*(F.struct(F.lit(k).alias("config"), F.array(*map(F.lit, v)).alias("langs")) for k, v in CONFIGS.items()))
    per = _t(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("docs")).select("lang", "docs", F.explode(every).alias("c")).select("lang", "docs", "c.*").filter(F.array_contains("langs", F.col("lang")))
    return per.select("config", "lang", F.array_join(first_language(F.col("langs"), F.col("lang")), ",").alias("tried"), "docs")


@query("SELECT 'documents' AS dataset, count(*) AS items FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'conversations', count(*) FROM conversations")
def corpus_counts(spark, d):
    counts = [_t(spark, d, n).agg(F.count("*").alias("items")).select(F.lit(n).alias("dataset"), "items") for n in ("documents", "pages", "conversations")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("WITH u AS (SELECT 0 AS ord, text FROM documents UNION ALL SELECT 1, html FROM pages UNION ALL SELECT 2, text FROM conversations) SELECT ord, count(*) AS items, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) FILTER (length(text) < 20) AS short FROM u GROUP BY ord")
def corpus_union(spark, d):
    parts = [_t(spark, d, n).select(F.lit(i).alias("ord"), F.col(c).alias("text")) for i, (n, c) in enumerate((("documents", "text"), ("pages", "html"), ("conversations", "text")))]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.groupBy("ord").agg(F.count("*").alias("items"), F.sum(F.length("text")).cast("long").alias("chars"), F.count_if(F.length("text") < 20).cast("long").alias("short"))


SOURCE_LABELS = {"EMAIL_ADDRESS": "EMAIL", "IP_ADDRESS": "IPV4", "PHONE_NUMBER": "PHONENUMBER", "CREDIT_CARD": "CREDITCARDNUMBER", "SECRET": "AGE"}


@query(f"WITH {TRUTH_SQL} SELECT type, count(*) AS spans FROM truth WHERE type <> 'SECRET' GROUP BY type")
def label_mapping(spark, d):
    """Values under source labels, mapped to types; the label of secrets here (AGE) has no type and is dropped."""
    label = F.create_map(*(F.lit(x) for kv in SOURCE_LABELS.items() for x in kv))
    mask = F.transform(truth_array(F.col("text")), lambda x: F.struct(F.element_at(label, x["type"]).alias("label"), x["pii"].alias("value")))
    spans = _t(spark, d, "documents").select(F.explode(sampling.gold_spans(mask)).alias("s"))
    return spans.groupBy(F.col("s.type").alias("type")).agg(F.count("*").alias("spans"))


_LABELS_SQL = ", ".join(f"('{k}', '{v}')" for k, v in sampling.LABEL_TYPES.items())
OTHER_LABELS = ("NONESUCH", "AGE", "email", "")


@query(f"WITH t(label, type) AS (VALUES {_LABELS_SQL}), n(label) AS (SELECT label FROM t UNION ALL VALUES {', '.join(f'({_q(x)})' for x in OTHER_LABELS)}), d AS (SELECT count(*) AS docs, CAST(sum(length(text) % 7) AS BIGINT) AS weight FROM documents) SELECT label, type, docs, weight FROM n LEFT JOIN t USING (label), d")
def label_types(spark, d):
    """The type of every source label, of the whole table, and of labels that it lacks (null)."""
    names = F.array(*map(F.lit, (*sampling.LABEL_TYPES, *OTHER_LABELS)))
    total = _t(spark, d, "documents").agg(F.count("*").alias("docs"), F.sum(F.length("text") % 7).cast("long").alias("weight"))
    return total.select(F.explode(names).alias("label"), "docs", "weight").select("label", sampling.mapped_type(F.col("label")).alias("type"), "docs", "weight")


@query("WITH q AS (SELECT doc_id, lang FROM documents WHERE length(text) BETWEEN 150 AND 1200 AND len(regexp_extract_all(text, '[^\\s]*[0-9][^\\s]*', 0)) >= 4), w AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS rn, count(*) OVER (PARTITION BY lang) AS n FROM q) SELECT doc_id, lang FROM w WHERE rn % greatest(1, n // 30) = 0 AND rn // greatest(1, n // 30) < 30")
def quality_sample(spark, d):
    """Evenly spaced documents of the right length that hold four spans at least (here: words with digits)."""
    spans = F.regexp_extract_all("text", F.lit(r"[^\s]*[0-9][^\s]*"), F.lit(0))
    docs = _t(spark, d, "documents").filter(sampling.in_quality(F.col("text"), spans)).select("doc_id", "lang")
    return sampling.even_sample(docs, 30, "lang", F.col("doc_id"))


# --- policies on real payloads ------------------------------------------------------------------------------------------

WIDE = (*LIGHT, Rule("url", "URL", URL, guard="://"), Rule("guess", "FINANCIAL", "[0-9]{5}", score=0.3))


@query(f"SELECT policy, type, count(*) AS n FROM (SELECT unnest(['all', 'allowlist']) AS policy, 'EMAIL_ADDRESS' AS type, text FROM (SELECT unnest(regexp_extract_all(text, {_q(EMAIL)}, 0)) AS text FROM documents) UNION ALL SELECT unnest(['all', 'allowlist']), 'IP_ADDRESS', text FROM (SELECT unnest(regexp_extract_all(text, {_q(IP)}, 0)) AS text FROM documents) UNION ALL SELECT 'all', 'URL', unnest(regexp_extract_all(text, {_q(URL)}, 0)) FROM documents) GROUP BY ALL")
def detect_allowed(spark, d):
    """Spans by type with and without the allowlist; a detector of low score is never heard."""
    named = lambda policy: lambda s: F.struct(F.lit(policy).alias("policy"), s["type"].alias("type"))
    spans = F.concat(*(F.transform(detect(F.col("text"), WIDE, allow=allow), named(policy)) for policy, allow in (("all", None), ("allowlist", ALLOWLIST))))
    return _t(spark, d, "documents").select(F.explode(spans).alias("s")).groupBy("s.policy", "s.type").agg(F.count("*").alias("n"))


POLICIES = {"allowlisted": (WIDE, ALLOWLIST, True), "flat_only": (LIGHT, None, False), "structured": (LIGHT, None, True)}


@query(f"""WITH {TRUTH_SQL}, o AS (SELECT doc_id, text, {_LIGHT_OUT} AS out FROM documents), p AS (
  SELECT policy, pii, contains(CASE policy WHEN 'flat_only' THEN text ELSE out END, pii) AS leak, NOT contains(out, pii) AS caught FROM truth JOIN o USING (doc_id), (SELECT unnest({sorted(POLICIES)!r}) AS policy))
SELECT policy, count(*) AS labels, {_c('leak')} AS tool_leaks, {_c('leak')} AS mm_leaks, {_c('caught')} AS caught, {_c('caught AND NOT leak')} AS protected, {_pct(_c('caught AND NOT leak'), _c('caught'))} AS tool_protection FROM p GROUP BY policy""")
def carrier_policies(spark, d):
    """The redactor itself, by policy, on payloads with a text part and a tool call: leaks in either, and how much of what is
    caught in flat text is protected in the call."""
    docs = _t(spark, d, "documents").withColumn("truth", F.transform(truth_array(F.col("text")), lambda x: x["pii"])).filter("size(truth) > 0")

    def of(name: str) -> Column:
        rules, allow, structured = POLICIES[name]
        held = lambda x: F.struct(F.array_join(P.leaves(P.first_arguments(x["messages"])), "\n").alias("args"), P.first_multimodal(x["messages"]).alias("mm"))
        return X.let(P.redact_payload(P.combined(F.col("text")), rules, structured, allow), held)

    flat = X.let(P.redact_payload(P.wrap(F.col("text"), "flat"), LIGHT), lambda x: P.flatten(x["messages"]))
    done = docs.select("truth", flat.alias("flat"), *(of(n).alias(n) for n in POLICIES))
    rows = done.select("truth", "flat", F.explode(F.array(*(F.struct(F.lit(n).alias("policy"), F.col(f"{n}.args").alias("args"), F.col(f"{n}.mm").alias("mm")) for n in POLICIES))).alias("p")).select("p.*", "flat", F.explode("truth").alias("pii"))
    each = rows.select("policy", X.literal_contains(F.col("args"), F.col("pii")).alias("tool"), X.literal_contains(F.col("mm"), F.col("pii")).alias("mm"), (~X.literal_contains(F.col("flat"), F.col("pii"))).alias("caught"))
    safe = F.count_if(F.col("caught") & ~F.col("tool")).cast("long")
    return each.groupBy("policy").agg(F.count("*").alias("labels"), _n("tool").alias("tool_leaks"), _n("mm").alias("mm_leaks"), _n("caught").alias("caught"), safe.alias("protected"), percent(safe, _n("caught")).alias("tool_protection"))


@query(f"WITH {TRUTH_SQL}, o AS (SELECT doc_id, {_LIGHT_OUT} AS out FROM documents), p AS (SELECT carrier, doc_id, pii, carrier <> 'flat' OR contains(out, pii) AS leaked, contains(out, pii) AS flat_leaked FROM truth JOIN o USING (doc_id), (SELECT unnest(['flat', 'multimodal', 'tool_call', 'tool_call_nested']) AS carrier)) SELECT carrier, doc_id, pii FROM p WHERE leaked AND NOT flat_leaked")
def flat_only_regressions(spark, d):
    """What a redactor that knows flat text alone catches there and leaks in other carriers."""
    docs = _t(spark, d, "documents").withColumn("truth", F.transform(truth_array(F.col("text")), lambda x: x["pii"])).filter("size(truth) > 0")
    left = lambda c: X.let(P.flatten(P.redact_payload(P.wrap(F.col("text"), c), LIGHT, structured=False)["messages"]), lambda out: F.filter("truth", lambda v: X.literal_contains(out, v)))
    done = docs.select("doc_id", *(left(c).alias(c) for c in P.CARRIERS))
    rows = F.array(*(F.struct(F.lit(c).alias("carrier"), F.array_except(c, "flat").alias("lost")) for c in P.CARRIERS))
    return done.select("doc_id", F.explode(rows).alias("x")).select("x.carrier", "doc_id", F.explode("x.lost").alias("pii"))


_NOTE = "CAST(json_object('note', text) AS VARCHAR)"
_NESTED = "CAST(json_object('user', json_object('profile', json_object('bio', text)), 'tags', json_array(text)) AS VARCHAR)"


@query(f"WITH {TRUTH_SQL}, o AS (SELECT doc_id, {_NOTE} AS a, {_NESTED} AS b, text <> {_LIGHT_OUT} AS changed FROM documents WHERE doc_id IN (SELECT doc_id FROM truth)) SELECT doc_id, 'tool_call' AS carrier, changed, md5(a) AS restored, TRUE AS ok FROM o UNION ALL SELECT doc_id, 'tool_call_nested', changed, md5(b), TRUE FROM o")
def carrier_roundtrips(spark, d):
    """Arguments of tool calls, redacted and restored: a digest of what comes back, and whether every value that was replaced is
    there again. Carriers without tool calls have nothing to check."""
    docs = _t(spark, d, "documents").withColumn("truth", F.transform(truth_array(F.col("text")), lambda x: x["pii"])).filter("size(truth) > 0")
    each = F.array(*(F.struct(F.lit(c).alias("carrier"), P.wrap(F.col("text"), c).alias("messages")) for c in P.CARRIERS))
    payloads = docs.select("doc_id", "truth", F.explode(each).alias("c")).select("doc_id", "truth", "c.*").withColumn("given", P.first_arguments(F.col("messages")))
    done = arguments.redact_payloads(payloads, LIGHT).withColumn("gone", X.let(P.flatten(F.col("messages")), lambda out: F.filter("truth", lambda v: ~X.literal_contains(out, v)))).withColumn("changed", P.first_arguments(F.col("messages")) != F.col("given"))
    back = arguments.restore_payloads(done.filter(F.startswith("carrier", F.lit("tool_call")))).withColumn("back", P.first_arguments(F.col("messages")))
    shown = F.array_join(P.leaves(F.col("back")), "\n")
    return back.select("doc_id", "carrier", "changed", F.md5("back").alias("restored"), X.let(shown, lambda x: F.forall("gone", lambda v: F.contains(x, v))).alias("ok"))


_ROLE = "CASE WHEN doc_id % 2 = 0 THEN 'assistant' ELSE 'user' END"


@query(f"""WITH {TRUTH_SQL}, o AS (SELECT doc_id, {_ROLE} AS role, {_LIGHT_OUT} AS out FROM documents), p AS (
  SELECT doc_id, role, count(*) AS total, {_c("contains(CASE WHEN role = 'assistant' THEN CAST(json_object('note', out) AS VARCHAR) ELSE out END, pii)")} AS leaked FROM truth JOIN o USING (doc_id) GROUP BY ALL)
SELECT role, count(*) AS payloads, CAST(sum(total) AS BIGINT) AS total, CAST(sum(total - leaked) AS BIGINT) AS anonymized, CAST(sum(leaked) AS BIGINT) AS leaked, sum(total - leaked) * 100.0::DOUBLE / sum(total) AS rate, {_c("role = 'assistant'")} AS rt_checked, {_c("role = 'assistant'")} AS rt_restored FROM p GROUP BY role""")
def native_summary(spark, d):
    """Chat payloads as they come (here: documents, of which those with even ids are an assistant's tool call): values anonymized
    and leaked, calls checked and restored."""
    m = F.when(F.col("role") == "assistant", P.wrap(F.col("text"), "tool_call")).otherwise(P.wrap(F.col("text"), "flat"))

    def of(r: Column) -> Column:
        leaks = X.let(P.flatten(r["messages"]), lambda out: F.filter("truth", lambda v: X.literal_contains(out, v)))
        return X.let(leaks, lambda x: F.struct(x.alias("leaked"), P.round_trip(r["messages"], r["mapping"], F.array_except("truth", x)).alias("rt")))

    said = _t(spark, d, "documents").withColumn("role", F.expr(_ROLE)).withColumn("truth", F.transform(truth_array(F.col("text")), lambda x: x["pii"])).filter("size(truth) > 0")
    done = said.select("role", "truth", X.let(P.redact_payload(m, LIGHT), of).alias("x"))
    total, leaked = F.sum(F.size("truth")).cast("long"), F.sum(F.size("x.leaked")).cast("long")
    return done.groupBy("role").agg(F.count("*").alias("payloads"), total.alias("total"), (total - leaked).alias("anonymized"), leaked.alias("leaked"), percent(total - leaked, total).alias("rate"), F.count("x.rt").alias("rt_checked"), F.count_if("x.rt").alias("rt_restored"))


@query("SELECT doc_id, md5(text || ' ') AS digest FROM documents")
def multimodal_text(spark, d):
    """Parts of the first message that has any, joined by blanks; the picture counts as empty."""
    return _t(spark, d, "documents").select("doc_id", F.md5(P.first_multimodal(P.combined(F.col("text")))).alias("digest"))


@query("SELECT doc_id, coalesce(l, 'fr') AS engine, coalesce(l, '?') AS result, coalesce(l, 'en') AS clean FROM (SELECT doc_id, nullif(lang, 'de') AS l FROM documents)")
def lang_defaults(spark, d):
    """What stands in for a missing language: for choosing detectors, in results, and for clean documents (German counts as
    missing here)."""
    lang = F.nullif("lang", F.lit("de"))
    return _t(spark, d, "documents").select("doc_id", *(default_language(lang, use).alias(use) for use in ("engine", "result", "clean")))


@query(f"WITH {TRUTH_SQL}, c AS (SELECT pii, type, 0 AS ord, doc_id AS place FROM truth UNION ALL SELECT unnest(regexp_extract_all(text, {_q(EMAIL)}, 0)), 'CONTACT', 1, doc_id FROM documents WHERE lang = 'en') SELECT pii, type, ord FROM (SELECT *, row_number() OVER (PARTITION BY pii ORDER BY ord DESC, place DESC, type DESC) AS rn FROM c) WHERE rn = 1")
def dictionary_merge(spark, d):
    """Terms of several corpora as one dictionary (here: all values, then contacts in English documents); the last one wins."""
    first = truth(_t(spark, d, "documents")).select("pii", "type", F.lit(0).alias("ord"), F.col("doc_id").alias("place"))
    second = _t(spark, d, "documents").filter("lang = 'en'").select(F.explode(F.regexp_extract_all("text", F.lit(EMAIL), F.lit(0))).alias("pii"), F.lit("CONTACT").alias("type"), F.lit(1).alias("ord"), F.col("doc_id").alias("place"))
    return sampling.last_wins(first.unionByName(second), ["pii"], "ord", "place", "type").select("pii", "type", "ord")


@query(r"SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, '([\p{L}\p{N}_]{4,})', 1))) = list_sort(list_distinct(regexp_extract_all(lower(text), '([\p{L}\p{N}_]{4,})', 1))) AS equal FROM documents")
def set_equality(spark, d):
    """Are the word tokens of a text and of its lower-case form the same set?"""
    same = lambda t: F.array_sort(F.array_distinct(X.word_tokens(t)))
    return _t(spark, d, "documents").select("doc_id", (same(F.col("text")) == same(F.lower("text"))).alias("equal"))


@query(SCORED_SQL + ", s AS (SELECT solution, lang, " + _pct(_c("caught")) + " AS r FROM scored GROUP BY ALL) SELECT solution, lang, round_even(r, 1) AS shown FROM s")
def shown_recall(spark, d):
    """Recall as it is displayed: one decimal, halves to even."""
    return _recall(spark, d, "lang").select("solution", "lang", X.shown(F.col("recall")).alias("shown"))


# --- secrets and order-free matching ------------------------------------------------------------------------------------

KEY = "[A-Za-z0-9+/=_-]{20,}"
_ENTROPY = "list_sum(list_transform(list_distinct(string_split({v}, '')), lambda c: -(length({v}) - length(replace({v}, c, ''))) / length({v})::DOUBLE * log2((length({v}) - length(replace({v}, c, ''))) / length({v})::DOUBLE)))"


@query(f"""WITH k AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, {_q(KEY)}, 0))) AS v FROM documents),
f AS (SELECT doc_id, v FROM k WHERE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND len(regexp_extract_all(v, '[A-Za-z][0-9]|[0-9][A-Za-z]')) * 16 >= length(v) AND {_ENTROPY.format(v='v')} >= 3.0),
t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, {_q(SECRET)}, 1)) AS v FROM documents),
c AS (SELECT count(*) FILTER (f.v IS NOT NULL AND t.v IS NOT NULL) AS tp, count(*) FILTER (t.v IS NULL) AS fp, count(*) FILTER (f.v IS NULL) AS fn FROM f FULL JOIN t ON f.doc_id = t.doc_id AND f.v = t.v)
SELECT tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0 END AS recall FROM c""")
def secret_quality(spark, d):
    """Keys found by what they look like (character changes, entropy) against the secrets that stand in quotes after a name."""
    found = F.array_distinct(F.filter(F.regexp_extract_all("text", F.lit(KEY), F.lit(0)), checksums.secret))
    known = F.array_distinct(F.regexp_extract_all("text", F.lit(SECRET), F.lit(1)))
    each = _t(spark, d, "documents").select(found.alias("f"), known.alias("t")).filter("size(f) > 0 or size(t) > 0")
    n = lambda c: F.size(c)
    counts = each.select(n(F.array_intersect("f", "t")).alias("tp"), n(F.array_except("f", "t")).alias("fp"), n(F.array_except("t", "f")).alias("fn"))
    return score.precision_recall(counts).drop("f1")


#: What the tagger is to learn from the tables: where the patterns find something.
GOLD = (Rule("email", "EMAIL_ADDRESS", EMAIL, guard="@"), Rule("ip", "IP_ADDRESS", IP, guard="."), Rule("phone", "PHONE_NUMBER", PHONE, guard="+"), Rule("card", "CREDIT_CARD", CARD, valid=checksums.luhn))


@query(None)
def tagger_quality(spark, d):
    """A tagger that learns from documents whose id's checksum is not 2 modulo 4, on the others: exact spans by type."""
    docs = _t(spark, d, "documents").select("doc_id", "text", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held"), resolve(detect(F.col("text"), GOLD)).alias("gold"))
    model = tagger.train(docs.filter(~F.col("held")).select("doc_id", "text", F.col("gold").alias("spans")), key=F.col("doc_id"))
    found = docs.filter("held").select("gold", detect(F.col("text"), [tagger.Tagger(model)]).alias("spans"))
    return score.precision_recall(tagger.span_scores(found), "type")


_CUES = r"(?:Mr|Mrs|Ms|Dr|Herr|Frau|Monsieur|Madame|Señor|Señora|Signor|Signora)"
CUE_TEXT = "concat(text, ' Dear Dr. ', upper(substr(md5(text), 1, 1)), lower(translate(substr(md5(text), 2, 6), '0123456789', 'ghijklmnop')), ' and Frau Älster lives in Köln. ')"


@query(f"SELECT doc_id, 'PERSON' AS type, unnest(regexp_extract_all(text, '{_CUES}[.]? ((?:\\p{{Lu}}[\\p{{L}}''-]+ ?){{1,3}}[\\p{{L}}])', 1)) AS pii FROM (SELECT doc_id, {CUE_TEXT} AS text FROM documents) UNION ALL SELECT doc_id, 'LOCATION', unnest(regexp_extract_all(text, '(?:lives in|based in|wohnt in|habite à|vive en|abita a) (\\p{{Lu}}[\\p{{L}}-]+)', 1)) FROM (SELECT doc_id, {CUE_TEXT} AS text FROM documents)")
def detect_cues(spark, d):
    """Names and places after a cue: in documents, to each of which a name made from its digest and a fixed place are added."""
    spans = detect(F.col("text"), [REGISTRY["person"], REGISTRY["location"]])
    return _t(spark, d, "documents").select("doc_id", F.expr(CUE_TEXT).alias("text")).select("doc_id", F.explode(spans).alias("s")).select("doc_id", F.col("s.type").alias("type"), F.col("s.text").alias("pii"))


@query(None)
def best_match(spark, d):
    """As greedy_match, with the most true positives that any order of the detections could give."""
    found = matching.with_best_match(_matched(spark, d), name="b")
    return found.select("doc_id", F.col("b.tp").alias("tp"), F.col("tp").alias("greedy_tp"), *(F.array_join(F.array_sort(F.col(f"b.{c}")), "|").alias(c) for c in ("matched", "fp", "fn")))


@query("SELECT DISTINCT coalesce(lang, '?') AS key FROM documents")
def language_keys(spark, d):
    """The languages there are, for reports that have a column for each."""
    return reports.keys(_t(spark, d, "documents"), "lang", "?")


# --- arguments by tree ------------------------------------------------------------------------------------------------


def _trees(text: Column) -> dict[str, Column]:
    """Arguments that hold a text in other ways than as a plain string value."""
    return {"document": F.to_json(F.struct(F.to_json(F.struct(F.array(text).alias("notes"))).alias("body"))), "key": F.to_json(F.create_map(text, F.lit(1))), "list": F.to_json(F.array(F.to_json(F.array(text)), F.lit("x")))}


@query(f"""WITH {TRUTH_SQL}, o AS (SELECT doc_id, {_LIGHT_OUT} AS out FROM documents), p AS (SELECT carrier, doc_id, pii, contains(out, pii) AS leaked FROM truth JOIN o USING (doc_id), (SELECT unnest(['document', 'key', 'list']) AS carrier))
SELECT carrier, count(*) AS labels, {_c('leaked')} AS leaked, count(DISTINCT doc_id) AS calls, count(DISTINCT doc_id) AS restored FROM p GROUP BY carrier""")
def tree_parity(spark, d):
    """What the light redactor leaves in arguments that hold a text in a document within a string, as an object key, or in a list
    within a string; and how many calls come back as they were."""
    docs = _t(spark, d, "documents").withColumn("truth", F.transform(truth_array(F.col("text")), lambda x: x["pii"])).filter("size(truth) > 0")
    each = F.array(*(F.struct(F.lit(k).alias("carrier"), a.alias("given")) for k, a in _trees(F.col("text")).items()))
    calls = docs.select("doc_id", "truth", F.explode(each).alias("c")).select("doc_id", "truth", "c.*").withColumn("messages", P.called(F.col("given")))
    done = arguments.redact_payloads(calls, LIGHT).withColumn("seen", P.first_arguments(F.col("messages")))
    back = arguments.restore_payloads(done).select("carrier", "doc_id", "truth", "given", "seen", P.first_arguments(F.col("messages")).alias("back"))
    leaks = F.size(F.filter("truth", lambda v: F.contains("seen", v)))
    return back.groupBy("carrier").agg(F.sum(F.size("truth")).cast("long").alias("labels"), F.sum(leaks).cast("long").alias("leaked"), F.count("*").alias("calls"), F.count_if(F.col("back") == F.col("given")).cast("long").alias("restored"))


# --- files and conversations ----------------------------------------------------------------------------------------------


@query("WITH f AS (SELECT CAST(doc_id % 97 AS VARCHAR) AS id, CASE WHEN length(text) % 2 = 0 THEN 0 ELSE 1 END AS file_ord, doc_id, md5(text) AS digest FROM documents) SELECT id, CASE WHEN file_ord = 0 THEN 'even' ELSE 'odd' END AS lang, digest FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY file_ord DESC, doc_id DESC) AS rn FROM f) WHERE rn = 1")
def file_last_wins(spark, d):
    """Documents as JSON lines in two places, one read after the other: of each id (here: doc_id modulo 97) the line that is read
    last wins, whatever splits the files are read in."""
    folder, paths = shared_path(spark, "masked"), {}
    rows = _t(spark, d, "documents").select("doc_id", (F.col("doc_id") % 97).cast("string").alias("id"), F.col("text").alias("source_text"), F.array().cast("array<struct<label:string,value:string>>").alias("privacy_mask"))
    for name, rest in (("even", 0), ("odd", 1)):
        paths[name] = f"{folder}/{name}"
        part = rows.filter(F.length("source_text") % 2 == rest)
        part.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select("id", "source_text", "privacy_mask").write.json(paths[name])
    return readers.last_lines(readers.masked_sources(spark, paths)).select("id", "lang", F.md5("source_text").alias("digest"))


#: What stands for a name in conversations: a capital letter and six small ones at least.
NAME = "[A-ZÀ-Ý][a-zà-ÿ]{6,}"
CHAT = (Rule("name", "PERSON", NAME), Rule("ip", "IP_ADDRESS", IP, guard="."))
_CHAT_SQL = "f AS (" + " UNION ALL ".join(f"SELECT conv_id, turn, '{t}' AS type, v[i] AS original, i FROM (SELECT conv_id, turn, v, unnest(range(1, len(v) + 1)) AS i FROM (SELECT conv_id, turn, regexp_extract_all(text, {_q(p)}, 0) AS v FROM conversations))" for t, p in (("PERSON", NAME), ("IP_ADDRESS", IP))) + "), g AS (SELECT conv_id, type, original, min(ROW(turn, i)) AS pos FROM f GROUP BY ALL), m AS (SELECT conv_id, type, original, '<' || type || '_' || row_number() OVER (PARTITION BY conv_id, type ORDER BY pos, original) || '>' AS fake FROM g)"


@query(f"WITH {_CHAT_SQL} SELECT * FROM m")
def conversation_mapping(spark, d):
    """Placeholders of every conversation, numbered by first occurrence over its turns."""
    return conversation.mapping_of(conversation.with_spans(_t(spark, d, "conversations"), CHAT))


@query(f"""WITH {_CHAT_SQL}, n AS (SELECT conv_id, turn, f.type, f.original, fake, length(f.original) AS n FROM f JOIN m USING (conv_id, type, original)),
c AS (SELECT conv_id, turn, count(*) AS placeholders, CAST(sum(length(fake) - n) AS BIGINT) AS longer FROM n GROUP BY conv_id, turn)
SELECT conv_id, turn, coalesce(placeholders, 0) AS placeholders, CAST(length(text) + coalesce(longer, 0) AS BIGINT) AS n_chars, md5(text) AS restored FROM conversations LEFT JOIN c USING (conv_id, turn)""")
def conversation_redaction(spark, d):
    """Turns redacted with their conversation's mapping: placeholders in each, the length, and a digest of what restoring gives."""
    done = conversation.redact_conversations(_t(spark, d, "conversations").select("conv_id", "turn", "text"), CHAT)
    return done.select("conv_id", "turn", F.regexp_count("text", F.lit("<[A-Z_]+_[0-9]+>")).cast("long").alias("placeholders"), F.length("text").cast("long").alias("n_chars"), F.md5(restored(F.col("text"), F.col("mapping"))).alias("restored"))
