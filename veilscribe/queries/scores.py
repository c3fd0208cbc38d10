"""Error rates, span and entity scores, and utterance benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilscribe.functions import distance, labels
from veilscribe.functions.text import mixed_chars, mixed_words
from veilscribe.operators import scoring, transcripts
from veilscribe.queries._tables import SCORES_SQL, UTTERANCES_SQL, conversation_scores, rounded, spread, table, utterances

_MODELS = [f"m{k}" for k in range(1, 8)]


def _turn_pairs(spark, sf_dir):
    """User turns with the next turn as their transcript: conv_id, turn, ref, hyp.  A turn without a next one has no transcript and is no pair."""
    turns = table(spark, sf_dir, "conversations").filter("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.min(F.struct("role", F.coalesce("text", F.lit("")).alias("text"))).alias("r"))
    nxt = F.lead("r.text").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = turns.select("conv_id", "turn", "r.role", F.col("r.text").alias("ref"), nxt.alias("hyp"))
    return pairs.filter("role = 'user' AND hyp IS NOT NULL")


def q_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word and character error rates of user turns against the next turn, whole."""
    rows = _turn_pairs(spark, sf_dir).select("conv_id", "turn", mixed_words("ref").alias("rw"), mixed_words("hyp").alias("hw"), mixed_chars("ref").alias("rc"), mixed_chars("hyp").alias("hc"))
    out = rows.select("conv_id", "turn", distance.error_rate(distance.token_distance(F.col("rw"), F.col("hw")), F.size("rw")).alias("wer"), distance.error_rate(distance.char_distance(F.col("rc"), F.col("hc")), F.size("rc")).alias("cer"))
    return rounded(out)


def _turns_as_conversations(spark, sf_dir):
    """A manifest and hypotheses made of the pairs of turns, in their order."""
    pairs = _turn_pairs(spark, sf_dir).withColumn("item_id", F.concat_ws("-", "conv_id", "turn"))
    return pairs.select("item_id", F.struct("conv_id", "turn").alias("_pos"), F.col("ref").alias("transcript")), pairs.select("item_id", F.col("hyp").alias("hypothesis"))


def q_corpus_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rates of all user turns as one text, by script of the reference and over all."""
    return rounded(transcripts.corpus_scores(*_turns_as_conversations(spark, sf_dir)))


def q_summed_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rates of whole user turns by script of the reference, as summed edits."""
    return rounded(transcripts.summed_scores(transcripts.score_conversations(*_turns_as_conversations(spark, sf_dir))))


def q_ordered_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation joined in order."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("source_item_id"), F.col("turn").cast("double").alias("start"), F.format_string("%010d", F.col("turn")).alias("segment_id"), "text")
    return transcripts.joined_hypotheses(turns).select("item_id", F.md5("hypothesis").alias("text_md5"))


def q_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits, substitutions, deletions and insertions of user turns against the next turn, whole."""
    pairs = _turn_pairs(spark, sf_dir).select("conv_id", "turn", "ref", F.col("hyp").alias("pred_raw"))
    return rounded(transcripts.score_utterances(pairs).drop("ref", "pred_raw", "ref_norm", "pred_norm"))


def q_substitution_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 word pairs most often put for each other, by role."""
    pairs = _turn_pairs(spark, sf_dir).select(F.col("role").alias("model"), F.lower("ref").alias("ref_norm"), F.lower("hyp").alias("pred_norm"))
    return transcripts.substitution_pairs(pairs)


def q_prf_by_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a length heuristic against quality labels: overall, by language, by source."""
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    guess, good = F.col("n_chars") % 3 > 0, F.col("quality") == 1
    hit = lambda c: F.when(c, 1).otherwise(0)
    return rounded(scoring.scores_by(both.select("lang", "source", hit(guess & good).alias("tp"), hit(guess & ~good).alias("fp"), hit(~guess & good).alias("fn")), "lang", "source", beta=2.0))


def _line_records(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")).alias("r")).select("l_orderkey", "l_linenumber", "r.*")
    a = F.col("l_linenumber") * 100
    q = F.col("l_quantity").cast("int")
    shift = (F.col("l_partkey") % 9).cast("int")
    entity = F.struct(F.col("l_returnflag").alias("pii_type"), F.lit("").alias("text"), a.cast("int").alias("start_char"), (a + q).cast("int").alias("end_char"))
    kind = F.when(F.col("l_suppkey") % 5 == 0, "N").otherwise(F.col("l_returnflag"))
    span = F.struct((a + shift).cast("int").alias("start"), (a + shift + q).cast("int").alias("end"), F.lower(kind).alias("type"), F.lit("").alias("text"), F.lit(None).cast("double").alias("score"), F.lit("rule").alias("source"))
    rows = li.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", entity.alias("e")))), lambda x: x["e"]).alias("entities"), F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", span.alias("s")))), lambda x: x["s"]).alias("spans"), F.min("l_linestatus").alias("language"))
    gold = rows.select(F.col("l_orderkey").alias("record_id"), "language", F.lit("").alias("transcript"), "entities")
    return rows.select(F.col("l_orderkey").alias("record_id"), "spans"), gold


def q_greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy span matching of order lines against shifted ones: scores overall, by type and by language."""
    matched = scoring.match_records(*_line_records(spark, sf_dir))
    out = scoring.outcomes(matched).withColumn("type", F.upper("type"))
    return scoring.scores_by(out, "type", "language", digits=4)


def q_record_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by record."""
    return scoring.record_scores(scoring.match_records(*_line_records(spark, sf_dir)))


def q_first_hit_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The simpler matching, where half of the shorter span is enough."""
    predictions, gold = _line_records(spark, sf_dir)
    upper = predictions.withColumn("spans", F.transform("spans", lambda s: s.withField("type", F.upper(s["type"])).withField("text", F.lit("p"))))
    gold = gold.withColumn("entities", F.transform("entities", lambda e: e.withField("text", F.lit("g"))))
    matched = scoring.match_records(upper, gold, first_hit=True)
    return scoring.scores_by(scoring.outcomes(matched), "language", digits=4)


def _tagged(spark, sf_dir):
    n = lambda w: F.length(w)
    tag = lambda w: F.when(n(w) % 5 == 0, "B-PER").when(n(w) % 5 == 1, "I-PER").when(n(w) % 5 == 2, "i-LOC").otherwise("O")
    other = lambda w: F.when(n(w) % 5 == 0, "B-PER").when(n(w) % 7 == 1, "I-PER").otherwise("O")
    tokens = F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\n]+"), lambda w: w != "")
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).select("doc_id", "lang", tokens.alias("tokens"))
    return docs.select(F.col("doc_id").alias("item_id"), F.col("lang").alias("split"), "lang", "tokens", F.transform("tokens", tag).alias("gold_tag_names"), F.transform("tokens", other).alias("predicted"))


def q_bio_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of tag sequences made of the words' lengths."""
    rows = _tagged(spark, sf_dir).select("item_id", F.explode(labels.entities(F.col("gold_tag_names"))).alias("e"))
    return rows.select("item_id", "e.type", "e.start", "e.end")


def q_bio_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict entity scores and token accuracy by language and over all."""
    items = scoring.bio_items(_tagged(spark, sf_dir), ["PER", "LOC"], tags_col="predicted")
    return rounded(scoring.bio_summary(scoring.bio_scores(items), 2.0))


def q_bio_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro and weighted means of the scores by type."""
    items = scoring.bio_items(_tagged(spark, sf_dir), ["PER", "LOC"], tags_col="predicted")
    return rounded(scoring.averaged(scoring.type_scores(scoring.bio_outcomes(items), 2.0)))


def q_error_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of sentences without predictions, all missed, or perfect: counts made of ids."""
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("split"), F.col("doc_id").alias("item_id"), (F.col("doc_id") % 4).alias("gold_entities"), (F.col("doc_id") % 3).alias("pred_entities"), (F.col("doc_id") % 2).alias("tp"), (F.col("doc_id") % 5 % 2).alias("fp"), (F.col("doc_id") % 7 % 2).alias("fn"))
    return rounded(scoring.error_profile(docs))


def q_label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags by language."""
    return scoring.label_distribution(_tagged(spark, sf_dir))


def q_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark summary by model for all, each session and each language."""
    return transcripts.scope_summary(utterances(spark, sf_dir), metrics=("wer", "cer"), errors=("hits", "substitutions"))


def q_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that all seven models get right, or all get wrong."""
    return transcripts.agreement(utterances(spark, sf_dir), _MODELS, good=15.0, bad=25.0)


def q_side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The models' rates side by side and their mean, for all segments of the first model."""
    return rounded(transcripts.side_by_side(utterances(spark, sf_dir), _MODELS))


def q_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best and 20 worst of these."""
    return rounded(transcripts.extremes(transcripts.side_by_side(utterances(spark, sf_dir), _MODELS), "avg_wer", 20)).select("seg_id", "avg_wer")


def q_runtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real-time factors by source."""
    rows = conversation_scores(spark, sf_dir).groupBy("source").agg(F.sum("duration_sec").alias("audio"), (F.count("*") * 2.5).alias("elapsed"), F.sum("hyp_word_tokens").alias("segments"))
    ratios = transcripts.runtime_ratios(F.col("audio"), F.col("elapsed"), F.col("segments"))
    return rounded(rows.select("source", *(c.alias(n) for n, c in ratios.items())))


QUERIES = {f.__name__: f for f in (q_wer, q_corpus_wer, q_summed_wer, q_ordered_concat, q_alignment, q_substitution_pairs, q_prf_by_scope, q_greedy_match, q_record_scores, q_first_hit_match, q_bio_entities, q_bio_summary, q_bio_types, q_error_profile, q_label_distribution, q_scopes, q_agreement, q_side_by_side, q_extremes, q_runtime)}


def prf_sql(beta: float, digits: int | None) -> str:
    """precision, recall, f1, fbeta of tp, fp, fn."""
    p, r = "coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0)", "coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0)"
    b2 = beta * beta
    wrap = (lambda x: f"round({x}, {digits})") if digits is not None else (lambda x: x)
    return ", ".join([f"{wrap(p)} AS precision", f"{wrap(r)} AS recall", wrap(f"coalesce(2 * {p} * {r} / nullif({p} + {r}, 0), 0)") + " AS f1", wrap(f"coalesce({1 + b2} * {p} * {r} / nullif({b2} * {p} + {r}, 0), 0)") + " AS fbeta"])


_PAIRS = """turns AS (SELECT conv_id, turn, min_by(role, (role, coalesce(text, ''))) AS role, min_by(coalesce(text, ''), (role, coalesce(text, ''))) AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn),
pairs AS (SELECT * FROM (SELECT conv_id, turn, role, text AS ref, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS hyp FROM turns) WHERE role = 'user' AND hyp IS NOT NULL)"""

_LINES = """li AS (SELECT l_orderkey, l_linenumber, min(struct_pack(p := l_partkey, s := l_suppkey, q := l_quantity, f := l_returnflag, t := l_linestatus)) AS r FROM lineitem GROUP BY l_orderkey, l_linenumber),
m AS (SELECT l_orderkey, r.f AS g, CASE WHEN r.s % 5 = 0 THEN 'N' ELSE r.f END AS k, r.p % 9 AS d, CAST(r.q AS INTEGER) AS q, min(r.t) OVER (PARTITION BY l_orderkey) AS language FROM li),
o AS (SELECT l_orderkey, language, g, k, g = k AND {hit} AS hit FROM m),
c AS (SELECT l_orderkey, language, g AS type, CASE WHEN hit THEN 1 ELSE 0 END AS tp, 0 AS fp, CASE WHEN hit THEN 0 ELSE 1 END AS fn FROM o UNION ALL SELECT l_orderkey, language, k, 0, 1, 0 FROM o WHERE NOT hit)"""
_IOU = "d < q AND (q - d) / CAST(q + d AS DOUBLE) >= 0.5"
_TAGGED = r"""tokens AS (SELECT doc_id, lang, unnest(w) AS w, unnest(range(0, len(w))) AS i FROM (SELECT doc_id, lang, list_filter(string_split_regex(coalesce(text, ''), '[ \n]+'), lambda x: x <> '') AS w FROM documents)),
tags AS (
  SELECT doc_id, lang, i, CASE length(w) % 5 WHEN 0 THEN 'B' WHEN 1 THEN 'I' WHEN 2 THEN 'I' ELSE 'O' END AS gp, CASE length(w) % 5 WHEN 0 THEN 'PER' WHEN 1 THEN 'PER' WHEN 2 THEN 'LOC' ELSE '' END AS gt,
    CASE WHEN length(w) % 5 = 0 THEN 'B' WHEN length(w) % 7 = 1 THEN 'I' ELSE 'O' END AS pp, CASE WHEN length(w) % 5 = 0 OR length(w) % 7 = 1 THEN 'PER' ELSE '' END AS pt FROM tokens)"""


def _entities(p: str, t: str) -> str:
    return f"""(SELECT doc_id, lang, min({t}) AS type, min(i) AS start, max(i) + 1 AS stop FROM (
    SELECT *, sum(CASE WHEN {p} = 'B' OR ({p} = 'I' AND t0 IS DISTINCT FROM {t}) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM (
      SELECT *, lag({t}) OVER (PARTITION BY doc_id ORDER BY i) AS t0 FROM tags)) WHERE {p} <> 'O' GROUP BY doc_id, lang, n)"""


_DIFF = f"""g AS {_entities('gp', 'gt')}, p AS {_entities('pp', 'pt')},
d AS (SELECT coalesce(g.lang, p.lang) AS lang, coalesce(g.type, p.type) AS type, CASE WHEN g.doc_id IS NOT NULL AND p.doc_id IS NOT NULL THEN 1 ELSE 0 END AS tp, CASE WHEN g.doc_id IS NULL THEN 1 ELSE 0 END AS fp, CASE WHEN p.doc_id IS NULL THEN 1 ELSE 0 END AS fn
  FROM g FULL JOIN p ON g.doc_id = p.doc_id AND g.type = p.type AND g.start = p.start AND g.stop = p.stop)"""

#: Tokens of pairs w(conv_id, turn, rw, hw) aligned: a cell of the edit table is cost * 2^32 - hits, a row of all tables at a time.
_EDITS = """r AS (SELECT conv_id, turn, unnest(rw) AS t, unnest(range(1, len(rw) + 1)) AS i FROM w),
h AS (SELECT conv_id, turn, unnest(hw) AS t, unnest(range(1, len(hw) + 1)) AS j FROM w),
cells AS (
  SELECT conv_id, turn, CAST(0 AS BIGINT) AS i, j, j * 4294967296 AS v FROM (SELECT conv_id, turn, unnest(range(0, len(hw) + 1)) AS j FROM w)
  UNION ALL
  SELECT conv_id, turn, i, j, min(c - j * 4294967296) OVER (PARTITION BY conv_id, turn ORDER BY j) + j * 4294967296 FROM (
    SELECT s.conv_id, s.turn, r.i, s.j, least(s.v + 4294967296, coalesce(lag(s.v) OVER (PARTITION BY s.conv_id, s.turn ORDER BY s.j) + CASE WHEN h.t = r.t THEN -1 ELSE 4294967296 END, s.v + 4294967296)) AS c
    FROM cells s JOIN r ON r.conv_id = s.conv_id AND r.turn = s.turn AND r.i = s.i + 1 LEFT JOIN h ON h.conv_id = s.conv_id AND h.turn = s.turn AND h.j = s.j)),
edits AS (
  SELECT conv_id, turn, n, m, cost, cost * 4294967296 - v AS hits, n + m - 2 * (cost * 4294967296 - v) - cost AS substitutions
  FROM (SELECT c.conv_id, c.turn, c.v, (c.v + 4294967295) // 4294967296 AS cost, len(w.rw) AS n, len(w.hw) AS m FROM cells c JOIN w ON w.conv_id = c.conv_id AND w.turn = c.turn AND c.i = len(w.rw) AND c.j = len(w.hw)))"""
_MIXED = r"""t AS (SELECT conv_id, turn, lower(regexp_replace(ref, '<[^>]+>', ' ', 'g')) AS a, lower(regexp_replace(hyp, '<[^>]+>', ' ', 'g')) AS b FROM pairs),
w AS (SELECT conv_id, turn, regexp_extract_all(a, '[a-z0-9]+|[\x{4e00}-\x{9fff}]') AS rw, regexp_extract_all(b, '[a-z0-9]+|[\x{4e00}-\x{9fff}]') AS hw, regexp_extract_all(a, '[a-z0-9\x{4e00}-\x{9fff}]') AS rc, regexp_extract_all(b, '[a-z0-9\x{4e00}-\x{9fff}]') AS hc FROM t)"""


def _char_edits(a: str, b: str) -> str:
    """The edit distance of lists of characters, each spelt as one byte; there are fewer than 94 different ones in a pair."""
    known = f"list_distinct(list_concat({a}, {b}))"
    spelt = "array_to_string(list_transform({x}, lambda c: chr(CAST(33 + list_position({known}, c) AS INTEGER))), '')"
    return f"CASE WHEN len({known}) < 94 THEN levenshtein({spelt.format(x=a, known=known)}, {spelt.format(x=b, known=known)}) END"


_WIDE = ", ".join(f"max(wer) FILTER (model = '{m}') AS wer_{m}" for m in _MODELS)
_NORM = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"

SQL = {
    "q_wer": f"""
WITH RECURSIVE {_PAIRS}, {_MIXED}, {_EDITS}
SELECT e.conv_id, e.turn, round(cost / nullif(CAST(n AS DOUBLE), 0), 6) AS wer, round({_char_edits('w.rc', 'w.hc')} / nullif(CAST(len(w.rc) AS DOUBLE), 0), 6) AS cer
FROM edits e JOIN w ON w.conv_id = e.conv_id AND w.turn = e.turn""",
    "q_summed_wer": f"""
WITH RECURSIVE {_PAIRS}, {_MIXED}, {_EDITS},
b AS (SELECT conv_id, turn, regexp_matches(a, '[一-鿿]') AS zh, regexp_matches(a, '[A-Za-z]') AS en FROM t),
x AS (SELECT CASE WHEN zh AND en THEN 'mixed' WHEN zh THEN 'zh' WHEN en THEN 'en' ELSE 'unknown' END AS bucket, cost, n, {_char_edits('w.rc', 'w.hc')} AS chars, len(w.rc) AS nc
  FROM edits e JOIN w ON w.conv_id = e.conv_id AND w.turn = e.turn JOIN b ON b.conv_id = e.conv_id AND b.turn = e.turn)
SELECT 'all' AS split, lang_bucket, count(*) AS num_conversations, round(sum(cost) / nullif(CAST(sum(n) AS DOUBLE), 0), 6) AS wer, round(sum(chars) / nullif(CAST(sum(nc) AS DOUBLE), 0), 6) AS cer, CAST(sum(n) AS BIGINT) AS ref_word_tokens, CAST(sum(nc) AS BIGINT) AS ref_chars
FROM (SELECT *, unnest([bucket, 'ALL']) AS lang_bucket FROM x) GROUP BY lang_bucket""",
    "q_alignment": f"""
WITH RECURSIVE {_PAIRS}, p AS (SELECT conv_id, turn, {_NORM.format('ref')} AS a, {_NORM.format('hyp')} AS b FROM pairs),
w AS (SELECT conv_id, turn, list_filter(string_split(a, ' '), lambda x: x <> '') AS rw, list_filter(string_split(b, ' '), lambda x: x <> '') AS hw, list_filter(string_split(a, ''), lambda x: x <> '') AS rc, list_filter(string_split(b, ''), lambda x: x <> '') AS hc FROM p), {_EDITS},
k AS (SELECT e.conv_id, e.turn, n, m, hits AS h, cost, substitutions AS s, {_char_edits('w.rc', 'w.hc')} AS chars, len(w.rc) AS nc FROM edits e JOIN w ON w.conv_id = e.conv_id AND w.turn = e.turn),
q AS (SELECT *, CASE WHEN n > 0 AND m > 0 THEN (h / CAST(n AS DOUBLE)) * (h / CAST(m AS DOUBLE)) ELSE 0 END AS wip FROM k)
SELECT conv_id, turn, round(100 * (cost / nullif(CAST(n AS DOUBLE), 0)), 6) AS wer, round(100 * coalesce(cost / nullif(CAST(h + cost AS DOUBLE), 0), 0), 6) AS mer, round(100 * (1 - wip), 6) AS wil, round(100 * wip, 6) AS wip, round(100 * (chars / nullif(CAST(nc AS DOUBLE), 0)), 6) AS cer,
  CAST(h AS BIGINT) AS hits, CAST(s AS BIGINT) AS substitutions, CAST(n - h - s AS BIGINT) AS deletions, CAST(m - h - s AS BIGINT) AS insertions FROM q""",
    "q_ordered_concat": r"SELECT CAST(conv_id AS VARCHAR) AS item_id, md5(coalesce(string_agg(CASE WHEN trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) <> '' THEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) END, ' ' ORDER BY turn), '')) AS text_md5 FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id",
    "q_prf_by_scope": f"""
WITH b AS (SELECT d.lang, d.source, CASE WHEN n_chars % 3 > 0 AND quality = 1 THEN 1 ELSE 0 END AS tp, CASE WHEN n_chars % 3 > 0 AND quality <> 1 THEN 1 ELSE 0 END AS fp, CASE WHEN n_chars % 3 = 0 AND quality = 1 THEN 1 ELSE 0 END AS fn FROM labels l JOIN documents d USING (doc_id)),
u AS (SELECT 'overall' AS scope, 'ALL' AS value, tp, fp, fn FROM b UNION ALL SELECT 'lang', lang, tp, fp, fn FROM b UNION ALL SELECT 'source', source, tp, fp, fn FROM b),
s AS (SELECT scope, value, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM u GROUP BY scope, value)
SELECT scope, value, tp, fp, fn, tp + fn AS support, {prf_sql(2.0, 6)} FROM s""",
    "q_greedy_match": f"""
WITH {_LINES.format(hit=_IOU)},
u AS (SELECT 'overall' AS scope, 'ALL' AS value, tp, fp, fn FROM c UNION ALL SELECT 'type', type, tp, fp, fn FROM c UNION ALL SELECT 'language', language, tp, fp, fn FROM c),
s AS (SELECT scope, value, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM u GROUP BY scope, value)
SELECT scope, value, tp, fp, fn, tp + fn AS support, {prf_sql(2.0, 4)} FROM s""",
    "q_record_scores": f"""
WITH {_LINES.format(hit=_IOU)},
s AS (SELECT l_orderkey AS record_id, min(language) AS language, CAST(sum(tp) AS INTEGER) AS tp, CAST(sum(fp) AS INTEGER) AS fp, CAST(sum(fn) AS INTEGER) AS fn FROM c GROUP BY l_orderkey)
SELECT record_id, language, tp, fp, fn, tp + fn AS gold_count, tp + fp AS pred_count, {prf_sql(2.0, 4)} FROM s""",
    "q_first_hit_match": f"""
WITH {_LINES.format(hit="d < q AND (q - d) / CAST(q AS DOUBLE) >= 0.5")},
u AS (SELECT 'overall' AS scope, 'ALL' AS value, tp, fp, fn FROM c UNION ALL SELECT 'language', language, tp, fp, fn FROM c),
s AS (SELECT scope, value, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM u GROUP BY scope, value)
SELECT scope, value, tp, fp, fn, tp + fn AS support, {prf_sql(2.0, 4)} FROM s""",
    "q_bio_entities": f"WITH {_TAGGED}, g AS {_entities('gp', 'gt')} SELECT doc_id AS item_id, type, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS \"end\" FROM g",
    "q_bio_summary": f"""
WITH {_TAGGED}, {_DIFF},
e AS (SELECT s AS split, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (SELECT unnest([lang, 'ALL']) AS s, tp, fp, fn FROM d) GROUP BY s),
t AS (SELECT s AS split, count(*) AS token_count, sum(ok) AS token_correct, count(DISTINCT doc_id) AS num_sentences FROM (SELECT unnest([lang, 'ALL']) AS s, doc_id, CASE WHEN gp = pp AND gt = pt THEN 1 ELSE 0 END AS ok FROM tags) GROUP BY s),
x AS (SELECT t.split, num_sentences, token_count, CAST(token_correct AS BIGINT) AS token_correct, CAST(coalesce(tp, 0) AS BIGINT) AS tp, CAST(coalesce(fp, 0) AS BIGINT) AS fp, CAST(coalesce(fn, 0) AS BIGINT) AS fn FROM t LEFT JOIN e ON e.split = t.split)
SELECT split, num_sentences, token_count, token_correct, tp, fp, fn, round(token_correct / CAST(token_count AS DOUBLE), 6) AS token_accuracy, tp + fn AS support, {prf_sql(2.0, 6)} FROM x""",
    "q_bio_types": f"""
WITH {_TAGGED}, {_DIFF},
s AS (SELECT lang, type, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tp) + sum(fn) AS support FROM d GROUP BY lang, type),
f AS (SELECT lang, support, {prf_sql(2.0, None)} FROM s)
SELECT lang AS split, round(avg(f1), 6) AS macro_f1, round(avg(fbeta), 6) AS macro_fbeta, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, round(sum(fbeta * support) / sum(support), 6) AS weighted_fbeta, CAST(sum(support) AS BIGINT) AS entity_support FROM f GROUP BY lang""",
    "q_error_profile": """
WITH d AS (SELECT coalesce(lang, 'unknown') AS split, doc_id % 4 AS g, doc_id % 3 AS p, doc_id % 2 AS tp, doc_id % 5 % 2 AS fp, doc_id % 7 % 2 AS fn FROM documents)
SELECT split, count(*) AS sentences, round(count(*) FILTER (p > 0) / CAST(count(*) AS DOUBLE), 6) AS predicted_any_rate, round(coalesce(count(*) FILTER (g > 0 AND p = 0) / nullif(CAST(count(*) FILTER (g > 0) AS DOUBLE), 0), 0), 6) AS missed_all_rate_given_gold,
  round(count(*) FILTER (fp = 0 AND fn = 0) / CAST(count(*) AS DOUBLE), 6) AS sentence_perfect_rate, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(sum(fn) / nullif(CAST(sum(tp) AS DOUBLE), 0), 6) AS fn_to_tp_ratio, round(sum(fp) / nullif(CAST(sum(tp) AS DOUBLE), 0), 6) AS fp_to_tp_ratio
FROM d GROUP BY split""",
    "q_label_distribution": f"WITH {_TAGGED} SELECT lang AS split, CASE WHEN gp = 'O' THEN 'O' WHEN gt = 'LOC' THEN 'i-LOC' ELSE gp || '-' || gt END AS tag, count(*) AS n FROM tags GROUP BY 1, 2",
    "q_scopes": f"""
WITH {UTTERANCES_SQL}, x AS (SELECT *, unnest(['ALL', session, 'lang:' || language]) AS scope FROM utterances)
SELECT model, scope, count(*) AS n_segs, round(sum(inference_sec) / sum(audio_dur_sec), 4) AS rtf, round(avg(wer), 3) AS avg_wer, round(avg(cer), 3) AS avg_cer, CAST(sum(hits) AS BIGINT) AS total_hits, CAST(sum(substitutions) AS BIGINT) AS total_substitutions FROM x GROUP BY model, scope""",
    "q_agreement": f"WITH {UTTERANCES_SQL} SELECT seg_id, bool_and(wer <= 15.0) AS all_good, bool_and(wer >= 25.0) AS all_bad FROM utterances GROUP BY seg_id HAVING count(DISTINCT model) = 7",
    "q_side_by_side": f"""
WITH {UTTERANCES_SQL}, w AS (SELECT seg_id, {_WIDE}, avg(wer) AS a FROM utterances GROUP BY seg_id HAVING count(*) FILTER (model = 'm1') > 0)
SELECT seg_id, {', '.join(f'wer_{m}' for m in _MODELS)}, round(a, 6) AS avg_wer FROM w""",
    "q_extremes": f"""
WITH {UTTERANCES_SQL}, u AS (SELECT seg_id, {_WIDE}, count(*) AS n FROM utterances GROUP BY seg_id HAVING count(*) FILTER (model = 'm1') > 0),
w AS (SELECT seg_id, ({' + '.join(f'coalesce(wer_{m}, 0)' for m in _MODELS)}) / n AS a FROM u),
r AS (SELECT *, row_number() OVER (ORDER BY a DESC, seg_id) AS hi, row_number() OVER (ORDER BY a, seg_id) AS lo FROM w)
SELECT seg_id, round(a, 6) AS avg_wer FROM r WHERE hi <= 20 OR lo <= 20""",
    "q_runtime": f"WITH {SCORES_SQL} SELECT source, round(count(*) * 2.5 / sum(duration_sec), 6) AS rtf, round(sum(duration_sec) / (count(*) * 2.5), 6) AS audio_sec_per_wall_sec, round(sum(hyp_word_tokens) / (count(*) * 2.5), 6) AS segments_per_sec FROM scores GROUP BY source",
}
