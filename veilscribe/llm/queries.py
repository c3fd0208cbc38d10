"""The queries of this subpackage and, where SQL can express them, their SQL.

Each query applies its operator to its whole table and derives digest columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscribe.llm import embeddings, fertility, mixing, packing, simhash, substrings, token_counts, token_files, url_lists, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents as examples that a first line asks for: at most 1024 tokens, 6 segments and 976 tokens after the first line in a sequence."""
    return packing.pack(_table(spark, sf_dir, "documents"), prompt_mark="\n", length=1024, max_segments=6, max_loss=976, with_ids=False)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint of three-word shingles and the component of fingerprints that differ in at most three bits."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=3)
    return found.select("doc_id", F.lower(F.hex("fingerprint")).alias("fingerprint"), "component_id")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of every document, with sources flattened to the square root of their sizes."""
    docs = _table(spark, sf_dir, "documents")
    return mixing.mix(docs, mixing.tempered(docs, power=0.5), seed=17).select("doc_id", "source", "copy", "copies", "place")


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its links at a cosine of 0.95 and the component that they make."""
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"), least=0.95)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as its record is read back from the archives."""
    archives = warc.write_archives(_table(spark, sf_dir, "pages"), min_revisit_bytes=0)
    read = warc.read_archives(spark, archives, with_payload=False).filter(F.col("record_type").isin("response", "revisit"))
    return read.select(F.expr("try_cast(headers['X-Page-Id'] AS bigint)").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("headers")["X-Refers-To-Page-Id"].cast("long").alias("refers_to"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as its ids are read back, by key, from the shards."""
    docs = _table(spark, sf_dir, "documents")
    return token_files.write_token_files(docs).read(docs, "doc_id", with_ids=False)


#: The lists of the URL query: each host enters one list on a day, leaves it and comes back, by the digits of its MD5;
#: a domain above it enters a list of its own.
_LISTS = ("adult", "malware", "spam", "tracker")


def op7_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page, fetched on a day of 2024 by its id, against dated list entries for the pages' own hosts."""
    captures = _table(spark, sf_dir, "pages").select("page_id", "url", F.expr("date_add(DATE'2024-01-01', CAST(pmod(page_id * 37, 366) AS int))").alias("fetched_on"))
    hosts = captures.select(url_lists.host_of("url").alias("host")).na.drop().distinct().withColumn("m", F.md5("host"))
    digits = "CAST(conv(substring(m, {}, {}), 16, 10) AS int)".format
    name = f"element_at(array{_LISTS}, 1 + {digits(1, 1)} % 4)"
    day = "date_add(DATE'2024-01-01', {})".format
    in_, out, again = f"{digits(2, 2)}", f"{digits(2, 2)} + {digits(4, 2)} % 90", f"{digits(2, 2)} + {digits(4, 2)} % 90 + {digits(6, 2)} % 90"
    own = hosts.selectExpr("host AS pattern", f"{name} AS list", f"inline(array(named_struct('action', 'add', 'since', {day(in_)}), named_struct('action', 'remove', 'since', {day(out)}), named_struct('action', 'add', 'since', {day(again)})))")
    above = hosts.filter("m < '4'").selectExpr(r"regexp_replace(host, '^[^.]*[.]', '') AS pattern", "'domain' AS list", "'add' AS action", f"{day('200 + ' + digits(8, 2))} AS since")
    return url_lists.judge(captures, own.unionByName(above.filter("instr(pattern, '.') > 0"))).select("page_id", "host", "fetched_on", F.concat_ws(",", "lists").alias("lists"), "blocked")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every document."""
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), limit=512)


def op9_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every document, with what it rests on; judged by language where there is a column of it."""
    docs = _table(spark, sf_dir, "documents")
    return fertility.assess(docs, lang_col="lang" if "lang" in docs.columns else None)


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words it has, those that an earlier passage has, and a digest of the rest."""
    cleaned = substrings.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), window=20)
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", " "))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_simhash, op3_mixing, op4_embeddings, op5_warc, op6_token_files, op7_url_lists, op8_token_counts, op9_fertility, op10_substrings)}

_NUMBER = "CAST(('0x' || substr(md5({}), 1, 13)) AS BIGINT)".format
SQL: dict[str, str] = {
    "op3_mixing": f"""
WITH RECURSIVE sized AS (
  SELECT source, CAST(sum(strlen(coalesce(text, ''))) AS DOUBLE) AS size FROM documents GROUP BY source),
weighted AS (SELECT source, size, pow(size, 0.5) AS weight FROM sized),
means AS (
  SELECT source, CASE WHEN size > 0 THEN weight / sum(CASE WHEN size > 0 THEN weight END) OVER () * (sum(size) OVER () / size) ELSE 0.0 END AS mean
  FROM weighted),
rates AS (SELECT source, greatest(CAST(ceil(mean / 64.0) AS BIGINT), 1) AS parts, mean / greatest(ceil(mean / 64.0), 1) AS rate FROM means),
cdf AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf WHERE k + 1 <= CAST(floor(rate + 12 * sqrt(rate) + 30) AS BIGINT)),
tables AS (SELECT source, list(c ORDER BY k) AS cs FROM cdf GROUP BY source),
drawn AS (
  SELECT d.doc_id, d.source, CAST(sum((
    SELECT len(list_filter(t.cs, lambda c: c <= {_NUMBER("'17|' || CAST(part.i AS VARCHAR) || '|' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')")} / 4503599627370496.0)))) AS BIGINT) AS copies
  FROM documents d JOIN rates r ON r.source IS NOT DISTINCT FROM d.source JOIN tables t ON t.source IS NOT DISTINCT FROM d.source,
       LATERAL (SELECT unnest(range(r.parts)) AS i) part
  GROUP BY d.doc_id, d.source)
SELECT doc_id, source, copy, copies, {_NUMBER("'17|place|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || CAST(copy AS VARCHAR)")} AS place
FROM (SELECT doc_id, source, copies, unnest(range(1, copies + 1)) AS copy FROM drawn WHERE copies > 0)""",
    "op4_embeddings": """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reached AS (
  SELECT vec_id AS node, vec_id AS seen FROM embeddings
  UNION
  SELECT r.node, l.b FROM reached r JOIN links l ON l.a = r.seen)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e
JOIN (SELECT node, min(seen) AS component_id FROM reached GROUP BY node) c ON c.node = e.vec_id
LEFT JOIN (SELECT a, count(*) AS n_links FROM links GROUP BY a) n ON n.a = e.vec_id""",
    "op5_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST(('0x' || substr(x, CAST(1 + 5 * (i // 4) AS BIGINT), 5)) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM f OR f IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM f THEN NULL ELSE f END AS refers_to
FROM d""",
    "op7_url_lists": r"""
WITH captures AS (
  SELECT page_id, nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '\.$', ''), '') AS host,
    DATE '2024-01-01' + CAST((page_id * 37) % 366 AS INTEGER) AS fetched_on FROM pages),
hosts AS (SELECT DISTINCT host, md5(host) AS m FROM captures WHERE host IS NOT NULL),
days AS (
  SELECT host, m, ['adult', 'malware', 'spam', 'tracker'][1 + CAST(('0x' || substr(m, 1, 1)) AS INTEGER) % 4] AS list,
    CAST(('0x' || substr(m, 2, 2)) AS INTEGER) AS a, CAST(('0x' || substr(m, 4, 2)) AS INTEGER) % 90 AS b, CAST(('0x' || substr(m, 6, 2)) AS INTEGER) % 90 AS c FROM hosts),
entries AS (
  SELECT host AS pattern, list, 'add' AS action, DATE '2024-01-01' + a AS since FROM days
  UNION ALL SELECT host, list, 'remove', DATE '2024-01-01' + (a + b) FROM days
  UNION ALL SELECT host, list, 'add', DATE '2024-01-01' + (a + b + c) FROM days
  UNION ALL SELECT regexp_replace(host, '^[^.]*[.]', ''), 'domain', 'add', DATE '2024-01-01' + (200 + CAST(('0x' || substr(m, 8, 2)) AS INTEGER)) FROM days
    WHERE m < '4' AND instr(regexp_replace(host, '^[^.]*[.]', ''), '.') > 0),
dated AS (SELECT pattern, list, since, min(action) AS action FROM entries GROUP BY ALL),
tails AS (
  SELECT DISTINCT host, fetched_on, array_to_string(list_slice(string_split(host, '.'), k, 1000), '.') AS tail
  FROM (SELECT host, fetched_on, unnest(range(1, len(string_split(host, '.')) + 1)) AS k FROM captures WHERE host IS NOT NULL)),
asked AS (SELECT DISTINCT t.host, t.fetched_on, t.tail, e.list FROM tails t JOIN (SELECT DISTINCT pattern, list FROM dated) e ON e.pattern = t.tail),
found AS (
  SELECT host, fetched_on, string_agg(DISTINCT list, ',' ORDER BY list) AS lists
  FROM (SELECT a.*, e.action FROM asked a ASOF JOIN dated e ON e.pattern = a.tail AND e.list = a.list AND a.fetched_on >= e.since)
  WHERE action = 'add' GROUP BY host, fetched_on)
SELECT c.page_id, c.host, c.fetched_on, coalesce(f.lists, '') AS lists, f.lists IS NOT NULL AS blocked
FROM captures c LEFT JOIN found f ON f.host = c.host AND f.fetched_on = c.fetched_on""",
}
