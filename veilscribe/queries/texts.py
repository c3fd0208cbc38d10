"""Rules, spans, redaction, and forms of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscribe.functions import text as T
from veilscribe.functions.labels import subword_labels
from veilscribe.functions.matches import find_spans
from veilscribe.functions.spans import clean_spans, iou, locate_entities, merge_adjacent, redact
from veilscribe.operators.detect import detect, gazetteer, llm_spans, segment_table, span_counts
from veilscribe.operators.rules import RULES, rule_spans
from veilscribe.queries._tables import SECONDS_SQL, events, rounded, spread, table

_SPAN = ("s.start", "s.end", "s.type", "s.text")
ONLY = {r.name: False for r in RULES}


def _rule(name: str):
    return next(r for r in RULES if r.name == name)


def _one_rule(spark, sf_dir, name):
    r = _rule(name)
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.explode(find_spans(F.col("text"), r.pattern, r.kind, hints=r.hints)).alias("s")).select("doc_id", *_SPAN)


def q_email_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mail addresses with their places."""
    return _one_rule(spark, sf_dir, "email")


def q_phone_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phone numbers in digits with their places."""
    return _one_rule(spark, sf_dir, "phone")


def q_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with e-mail addresses replaced."""
    found = detect(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), toggles=ONLY | {"email": True}, merge_gap=0, min_chars=1)
    return found.select("doc_id", redact(F.col("text"), F.col("spans")).alias("redacted"), F.size("spans").alias("n_spans"))


def q_span_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged spans of the phone and e-mail rules by type."""
    found = detect(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), toggles=ONLY | {"email": True, "phone": True}, merge_gap=1, min_chars=2)
    return span_counts(found)


def q_all_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All thirteen rules on all documents: merged spans with their texts."""
    # before a plain explode Spark filters by the array's size: below the shuffle, and all rules run twice
    found = detect(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), toggles={"generic_id": True}, merge_gap=1, min_chars=2)
    return found.select("doc_id", F.explode_outer("spans").alias("s")).filter("s IS NOT NULL").select("doc_id", *_SPAN)


#: Texts with a number of the key in them, what the rule finds there and how far into the text: type, before, found, after.
_PLANTED = {
    0: ("ID", "nric ", "concat('S', lpad(ks, 7, '0'), 'A')", " ok"),
    1: ("PHONE", "please call ", "lpad(ks, 5, '1')", " now"),
    2: ("ADDRESS", "at ", "concat('Block ', ks, ' Orchard Road')", " today"),
    3: ("PHONE", "电话是", "'九八一零二三四五'", "。"),
    4: ("ID", "staff id number is ", "concat('AB-', lpad(ks, 4, '0'))", " ;"),
    5: ("ADDRESS", "zip ", "concat('Singapore ', lpad(ks, 6, '6'))", " end"),
    6: ("EMAIL", "mail ", "concat('user.', ks, '@mail.example.com')", " !"),
    7: ("PHONE", "dial it: ", "'nine one three two five six seven eight'", " please"),
    8: ("ADDRESS", "", "'中山路大牌三零一'", "，"),
    9: ("ID", "我的员工编号是", "concat('STAFF', lpad(ks, 4, '0'))", "。"),
}


def _planted(column: str) -> str:
    """The parts of a planted text as one CASE each, for both engines."""
    at = {"type": 0, "before": 1, "found": 2, "after": 3}[column]
    return "CASE k % 10 " + " ".join(f"WHEN {i} THEN " + (p[at] if at == 2 else f"'{p[at]}'") for i, p in _PLANTED.items()) + " END"


def q_rules_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules on texts made of customer keys: the merged spans."""
    keyed = spread(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")))
    texts = keyed.withColumn("ks", F.col("k").cast("string")).selectExpr("k", f"concat({_planted('before')}, {_planted('found')}, {_planted('after')}) AS text")
    found = detect(texts, toggles={"generic_id": True}, merge_gap=1, min_chars=2)
    return found.select("k", F.explode_outer("spans").alias("s")).filter("s IS NOT NULL").select("k", *_SPAN)


def q_raw_rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many matches each planted text has before cleaning."""
    keyed = spread(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")))
    texts = keyed.selectExpr("k", "CASE k % 3 WHEN 0 THEN concat('nric T', lpad(CAST(k AS string), 7, '0'), 'b x') WHEN 1 THEN '九八一零，二三四五' ELSE concat('a', k, '@b.co a', k, '@c.co') END AS text")
    return texts.select("k", F.size(rule_spans(F.col("text"))).alias("n"))


def q_script_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Script buckets and counts of names, some with Chinese, some without letters."""
    names = table(spark, sf_dir, "customer").selectExpr("c_custkey", "CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN concat('客户', c_name) WHEN 2 THEN concat('客户', c_custkey) ELSE concat('<EN>', c_custkey) END AS text")
    n = T.script_counts("text")
    return names.select("c_custkey", T.script_bucket("text").alias("bucket"), T.reference_bucket("text").alias("cleaned_bucket"), n["zh_chars"].alias("zh_chars"), n["en_chars"].alias("en_chars"))


def q_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and characters of documents as error rates count them."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.mixed_words("text")).alias("n_words"), F.size(T.mixed_chars("text")).alias("n_chars_kept"))


def q_number_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in digits and in words as one token."""
    texts = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "CASE o_orderkey % 5 WHEN 0 THEN concat('pay ', o_orderkey, '.50 now') WHEN 1 THEN 'twenty one dogs' WHEN 2 THEN 'one dog and a cat' WHEN 3 THEN concat('from 1,000-', o_orderkey, ' to two') ELSE 'oh and and minus five' END AS text")
    return texts.select("o_orderkey", T.clean_transcript("text", numbers=True).alias("folded"))


def q_text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes, labels, ids, buckets and previews of texts made of order keys."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey",
        T.language_code(F.element_at(F.array(*map(F.lit, (" English", "mandarin", "zh-TW", "", "fr"))), (F.col("o_orderkey") % 5 + 1).cast("int"))).alias("code"),
        T.entity_label(F.concat(F.element_at(F.array(*map(F.lit, ("b-", "I-", "", "x-"))), (F.col("o_orderkey") % 4 + 1).cast("int")), F.lit("per "))).alias("label"),
        T.speaker_session(F.concat(F.lit("en_U"), F.col("o_custkey"), F.lit("_S"), F.col("o_orderkey") % 3))["speaker_id"].alias("speaker"),
        T.utterance_text(F.concat(F.lit("  A "), F.col("o_orderpriority"), F.lit("\t\nB "))).alias("norm"),
        T.ratio_mode(F.col("o_orderkey") % 200 / 100.0).alias("ratio_mode"),
        T.length_bucket(F.repeat(F.lit("w "), (F.col("o_orderkey") % 20).cast("int"))).alias("length_bucket"),
        T.token_preview(F.split("o_orderpriority", ""), 3).alias("preview"),
        T.safe_name("o_orderpriority").alias("safe"),
        F.size(T.utterance_tokens("o_orderstatus")).alias("n_status_tokens"),
        T.tag_counts(F.concat(F.lit("<FIL/><FIL>"), F.repeat(F.lit("<EN>"), (F.col("o_orderkey") % 3).cast("int"))))["tag_EN"].alias("tag_en"),
    )


def q_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of two decodings is chosen, and the language for decoding again."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "CASE o_orderkey % 3 WHEN 0 THEN 'hello there' WHEN 1 THEN 'saya dan itu' ELSE '123' END AS en", "CASE o_orderkey % 4 WHEN 0 THEN '你好' WHEN 1 THEN '你好 hi' WHEN 2 THEN 'hello there everybody now' ELSE '' END AS zh")
    return o.select("o_orderkey", T.choose_candidate("en", "zh")["chosen"].alias("chosen"), T.choose_candidate("en", "zh", hints=False)["chosen"].alias("chosen_plain"), T.decode_language("zh", ["en", "zh"], "en").alias("decode_language"))


def _event_spans(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", (F.floor("start") % 100000).cast("int").alias("a"), F.floor("value").cast("int").alias("n"), "event_type")
    span = F.struct(F.col("a").alias("start"), (F.col("a") + F.col("n")).alias("end"), F.col("event_type").alias("type"), F.lit("").alias("text"), F.lit(None).cast("double").alias("score"), F.lit("rule").alias("source"))
    return rows.groupBy("user_id").agg(F.collect_list(span).alias("spans"))


def q_span_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans cleaned and merged within each row: events of a user as spans of their type."""
    merged = merge_adjacent(F.lit(""), F.col("clean"), 900)
    rows = _event_spans(spark, sf_dir).withColumn("clean", clean_spans(F.lit(""), F.col("spans"), 2))
    return rows.select("user_id", F.explode(merged).alias("s")).select("user_id", "s.start", "s.end", "s.type")


def q_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of neighbouring events."""
    li = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "CAST(l_partkey % 40 AS int) AS a", "CAST(l_partkey % 40 + l_quantity AS int) AS b", "CAST(l_suppkey % 40 AS int) AS c", "CAST(l_suppkey % 40 + 20 AS int) AS d")
    return rounded(li.groupBy("l_orderkey").agg(F.sum(F.round(iou(F.col("a"), F.col("b"), F.col("c"), F.col("d")), 8)).alias("iou")))


def q_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of entities that have none: the third mention takes the third place, and one too many the first again."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "concat(o_orderpriority, ' x ', o_orderpriority, ' y') AS text", "o_orderpriority AS name")
    entity = F.struct(F.lit("NAME").alias("pii_type"), F.col("name").alias("text"), F.lit(None).cast("int").alias("start_char"), F.lit(None).cast("int").alias("end_char"))
    missing = F.struct(F.lit("ID").alias("pii_type"), F.lit("absent").alias("text"), F.lit(None).cast("int").alias("start_char"), F.lit(None).cast("int").alias("end_char"))
    return o.select("o_orderkey", F.posexplode(locate_entities(F.col("text"), F.array(entity, entity, entity, missing))).alias("i", "e")).select("o_orderkey", "i", "e.pii_type", "e.start_char", "e.end_char")


def q_llm_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of language model answers: clean, wrapped in words, and unusable."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "concat('I am ', o_orderpriority, ' here') AS text", "concat('[{\"pii_type\": \"name\", \"text\": \"', o_orderpriority, '\"}, {\"pii_type\": \"other\", \"text\": \"I\"}]') AS j")
    o = o.withColumn("answer", F.expr("CASE o_orderkey % 4 WHEN 0 THEN j WHEN 1 THEN concat('Sure: ', j, ' done') WHEN 2 THEN concat('{\"a\": ', j, '}') ELSE 'none' END"))
    return o.select("o_orderkey", F.explode(llm_spans(F.col("text"), F.col("answer"))).alias("s")).select("o_orderkey", *_SPAN)


def q_model_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pluggable model on all conversations: a gazetteer of two words, with labels mapped."""
    found = detect(table(spark, sf_dir, "conversations"), rules=False, model=gazetteer({"the": "PER", "de": "LOC"}), aliases={"PER": "NAME", "B-LOC": "ADDRESS"}, merge_gap=0, min_chars=1)
    return span_counts(found)


def q_segment_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns with their redacted text: turns that hold an ``e`` have a span at its place."""
    turns = table(spark, sf_dir, "conversations").filter("text IS NOT NULL").select(F.concat_ws("-", "conv_id", "turn").alias("segment_id"), F.col("role").alias("language"), (F.col("turn") * 1.234).alias("start"), (F.col("turn") * 1.234 + 1).alias("end"), "text")
    turns = turns.dropDuplicates(["segment_id"])
    at = F.locate("e", F.col("text"))
    span = F.struct((at - 1).alias("start"), at.alias("end"), F.lit("name").alias("type"), F.lit("e").alias("text"), F.lit(None).cast("double").alias("score"), F.lit("rule").alias("source"))
    spans = turns.filter(at > 0).select("segment_id", F.array(span).alias("spans"), F.lit(0).alias("_pos"))
    return segment_table(turns, spans).withColumnRenamed("start", "start_sec").withColumnRenamed("end", "end_sec")


def q_subword_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label ids of tokens of five characters from one entity of the middle third of the text, counted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"))
    offsets = F.transform(F.sequence(F.lit(0), F.floor(F.col("n") / 5).cast("int")), lambda i: F.struct((i * 5).alias("start"), F.least(i * 5 + 5, F.col("n")).alias("end")))
    entity = F.struct(F.lit("NAME").alias("pii_type"), F.lit("").alias("text"), F.floor(F.col("n") / 3).cast("int").alias("start_char"), F.floor(2 * F.col("n") / 3).cast("int").alias("end_char"))
    ids = {"O": 0, "B-NAME": 1, "I-NAME": 2}
    labels = docs.select("doc_id", F.explode(subword_labels(offsets, F.array(entity), ids)).alias("label"))
    return labels.groupBy("doc_id", "label").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (q_email_spans, q_phone_spans, q_redact, q_span_types, q_all_rules, q_rules_planted, q_raw_rule_hits, q_script_bucket, q_token_counts, q_number_fold, q_text_forms, q_candidates, q_span_merge, q_iou, q_locate, q_llm_spans, q_model_detect, q_segment_table, q_subword_labels)}

_EMAIL_SQL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
_PHONE_SQL = r"\+?\d[\d\-\s]{6,}\d"


def _spans_sql(pattern: str, kind: str, where: str) -> str:
    return f"""
WITH m AS (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS hits, string_split_regex(text, '{pattern}') AS gaps FROM documents WHERE {where}),
i AS (SELECT doc_id, hits, gaps, unnest(range(1, len(hits) + 1)) AS k FROM m),
s AS (SELECT doc_id, hits[k] AS text, list_sum(list_transform(gaps[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:k-1], lambda g: length(g))), 0) AS st FROM i)
SELECT doc_id, CAST(st AS INTEGER) AS start, CAST(st + length(text) AS INTEGER) AS "end", '{kind}' AS type, text FROM s"""


SQL = {
    "q_email_spans": _spans_sql(_EMAIL_SQL, "EMAIL", "contains(text, '@')"),
    "q_phone_spans": _spans_sql(_PHONE_SQL, "PHONE", f"regexp_matches(text, '{_PHONE_SQL}')"),
    "q_redact": f"SELECT doc_id, regexp_replace(coalesce(text, ''), '{_EMAIL_SQL}', '[EMAIL]', 'g') AS redacted, CAST(coalesce(len(regexp_extract_all(text, '{_EMAIL_SQL}')), 0) AS INTEGER) AS n_spans FROM documents",
    "q_span_types": f"""
WITH e AS ({_spans_sql(_EMAIL_SQL, "EMAIL", "contains(text, '@')")}),
p AS ({_spans_sql(_PHONE_SQL, "PHONE", f"regexp_matches(text, '{_PHONE_SQL}')")}),
o AS (SELECT *, lag(type) OVER w AS t0 FROM (SELECT * FROM e UNION ALL SELECT * FROM p) WINDOW w AS (PARTITION BY doc_id ORDER BY start, "end", type)),
r AS (SELECT *, sum(CASE WHEN t0 IS DISTINCT FROM type THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start, "end", type) AS run FROM o),
b AS (SELECT *, max("end") OVER (PARTITION BY doc_id, run ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r)
SELECT type AS pii_type, count(*) AS n_spans FROM b WHERE before IS NULL OR start > before + 1 GROUP BY type""",
    "q_rules_planted": f"""
WITH t AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS ks FROM customer),
p AS (SELECT k, {_planted('type')} AS type, {_planted('before')} AS before, {_planted('found')} AS text FROM t)
SELECT k, CAST(length(before) AS INTEGER) AS start, CAST(length(before) + length(text) AS INTEGER) AS "end", type, text FROM p""",
    "q_raw_rule_hits": "SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 2 THEN 2 ELSE 1 END AS n FROM customer",
    "q_script_bucket": """
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'mixed' WHEN 2 THEN 'zh' ELSE 'en' END AS bucket, CASE c_custkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'mixed' WHEN 2 THEN 'zh' ELSE 'unknown' END AS cleaned_bucket,
  CASE WHEN c_custkey % 4 IN (1, 2) THEN 2 ELSE 0 END AS zh_chars, CAST(CASE c_custkey % 4 WHEN 2 THEN 0 WHEN 3 THEN 2 ELSE length(regexp_replace(c_name, '[^A-Za-z]', '', 'g')) END AS INTEGER) AS en_chars
FROM customer""",
    "q_token_counts": r"""
WITH c AS (SELECT doc_id, lower(regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CAST(len(regexp_extract_all(t, '[a-z0-9]+|[\x{4e00}-\x{9fff}]')) AS INTEGER) AS n_words, CAST(len(regexp_extract_all(t, '[a-z0-9\x{4e00}-\x{9fff}]')) AS INTEGER) AS n_chars_kept FROM c""",
    "q_number_fold": "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'pay num now' WHEN 1 THEN 'num dogs' WHEN 2 THEN 'one dog and a cat' WHEN 3 THEN 'from num to num' ELSE 'num' END AS folded FROM orders",
    "q_text_forms": r"""
SELECT o_orderkey, ['en', 'zh', 'zh', 'auto', 'fr'][CAST(o_orderkey % 5 + 1 AS INTEGER)] AS code, ['PER', 'PER', 'PER', 'X-PER'][CAST(o_orderkey % 4 + 1 AS INTEGER)] AS label, 'U' || o_custkey AS speaker, 'a ' || lower(o_orderpriority) || ' b' AS norm,
  CASE WHEN o_orderkey % 200 < 75 THEN 'under_generate_lt_0.75' WHEN o_orderkey % 200 <= 125 THEN 'balanced_0.75_to_1.25' ELSE 'over_generate_gt_1.25' END AS ratio_mode,
  CASE WHEN o_orderkey % 20 <= 5 THEN '1–5 words' WHEN o_orderkey % 20 <= 10 THEN '6–10 words' WHEN o_orderkey % 20 <= 15 THEN '11–15 words' ELSE '16+ words' END AS length_bucket,
  array_to_string(string_split(o_orderpriority, '')[1:3], ' ') || ' ...' AS preview, regexp_replace(o_orderpriority, '[^A-Za-z0-9._-]+', '_', 'g') AS safe, CAST(length(o_orderstatus) AS INTEGER) AS n_status_tokens, CAST(o_orderkey % 3 AS INTEGER) AS tag_en
FROM orders""",
    "q_candidates": """
WITH c AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 2 - 6 ELSE 0 END AS e, CASE o_orderkey % 3 WHEN 2 THEN 0 ELSE 2 END AS ep, CASE o_orderkey % 4 WHEN 0 THEN 4 WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 0 END AS z, CASE o_orderkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 0 END AS zp FROM orders)
SELECT o_orderkey, CASE WHEN e > z THEN 'en_prompt' ELSE 'zh_prompt' END AS chosen, CASE WHEN ep > zp THEN 'en_prompt' ELSE 'zh_prompt' END AS chosen_plain, CASE o_orderkey % 4 WHEN 0 THEN 'zh' WHEN 1 THEN 'en' WHEN 2 THEN 'en' ELSE 'en' END AS decode_language FROM c""",
    "q_span_merge": f"""
WITH s AS (SELECT DISTINCT user_id, CAST(floor({SECONDS_SQL}) AS BIGINT) % 100000 AS a, CAST(floor({SECONDS_SQL}) AS BIGINT) % 100000 + CAST(floor(value) AS BIGINT) AS b, event_type AS t FROM events WHERE floor(value) >= 2),
o AS (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY a, b, t) AS t0 FROM s),
r AS (SELECT *, sum(CASE WHEN t0 IS DISTINCT FROM t THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b, t) AS run FROM o),
m AS (SELECT *, max(b) OVER (PARTITION BY user_id, run ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before + 900 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY a, b) AS island FROM m)
SELECT user_id, CAST(min(a) AS INTEGER) AS start, CAST(max(b) AS INTEGER) AS "end", min(t) AS type FROM i GROUP BY user_id, run, island""",
    "q_iou": """
WITH s AS (SELECT l_orderkey, l_partkey % 40 AS a, CAST(l_partkey % 40 + l_quantity AS INTEGER) AS b, l_suppkey % 40 AS c, l_suppkey % 40 + 20 AS d FROM lineitem)
SELECT l_orderkey, round(sum(CASE WHEN greatest(a, c) < least(b, d) THEN round((least(b, d) - greatest(a, c)) / CAST(greatest(b, d) - least(a, c) AS DOUBLE), 8) ELSE 0 END), 6) AS iou FROM s GROUP BY l_orderkey""",
    "q_locate": """
SELECT o_orderkey, i, CASE WHEN i = 3 THEN 'ID' ELSE 'NAME' END AS pii_type, CAST(CASE i WHEN 1 THEN length(o_orderpriority) + 3 WHEN 3 THEN NULL ELSE 0 END AS INTEGER) AS start_char, CAST(CASE i WHEN 1 THEN 2 * length(o_orderpriority) + 3 WHEN 3 THEN NULL ELSE length(o_orderpriority) END AS INTEGER) AS end_char
FROM orders, (SELECT CAST(unnest(range(0, 4)) AS INTEGER) AS i)""",
    "q_llm_spans": "SELECT o_orderkey, 5 AS start, CAST(5 + length(o_orderpriority) AS INTEGER) AS \"end\", 'NAME' AS type, o_orderpriority AS text FROM orders WHERE o_orderkey % 4 IN (0, 1)",
    "q_model_detect": """
WITH c AS (SELECT coalesce(text, '') AS t FROM conversations)
SELECT 'NAME' AS pii_type, CAST(sum(len(regexp_extract_all(t, '(?:the)+'))) AS BIGINT) AS n_spans FROM c HAVING sum(len(regexp_extract_all(t, '(?:the)+'))) > 0
UNION ALL SELECT 'ADDRESS', CAST(sum(len(regexp_extract_all(t, '(?:de)+'))) AS BIGINT) FROM c HAVING sum(len(regexp_extract_all(t, '(?:de)+'))) > 0""",
    "q_segment_table": """
SELECT conv_id || '-' || turn AS segment_id, role AS language, CAST(round(turn * 1.234, 2) AS DOUBLE) AS start_sec, CAST(round(turn * 1.234 + 1, 2) AS DOUBLE) AS end_sec, CAST(CASE WHEN contains(text, 'e') THEN 1 ELSE 0 END AS INTEGER) AS detected_spans, text AS transcript,
  CASE WHEN contains(text, 'e') THEN substr(text, 1, strpos(text, 'e') - 1) || '[NAME]' || substr(text, strpos(text, 'e') + 1) ELSE text END AS redacted_transcript
FROM conversations WHERE text IS NOT NULL""",
    "q_subword_labels": """
WITH d AS (SELECT doc_id, CAST(length(text) AS INTEGER) AS n FROM documents),
t AS (SELECT doc_id, n, unnest(range(0, n // 5 + 1)) * 5 AS a FROM d),
o AS (SELECT doc_id, a, least(a + 5, n) AS b, n // 3 AS s, 2 * n // 3 AS e FROM t)
SELECT doc_id, CASE WHEN a = 0 AND b = 0 THEN -100 WHEN a < e AND b > s THEN CASE WHEN a <= s THEN 1 ELSE 2 END ELSE 0 END AS label, count(*) AS n FROM o GROUP BY 1, 2""",
}
