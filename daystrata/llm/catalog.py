"""Queries of the training-data operators over whole tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daystrata.llm import chat, decontamination, hashing, html, lexical, mil, mixing, phrases, secrets, simhash, toxicity, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Rows of an Arrow batch. Texts differ in length by thousands, so batches are kept well below Spark's 10,000 rows.
BATCH_ROWS = "1000"


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            small_batches(spark)
            return fn(spark, sf_dir)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_suffix_decontamination", r"""
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS gram
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p
        FROM items WHERE len(w) > 0)),
grams AS (
  SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p
        FROM lowered, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
found AS (SELECT g.doc_id, g.p, g.n, x.item_id FROM grams g JOIN windows x USING (n, gram)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM found) GROUP BY 1),
named AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n.n_items, 0) AS BIGINT) AS n_items, coalesce(n.items_sha256, sha256('')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM lowered d LEFT JOIN hit h USING (doc_id) LEFT JOIN named n USING (doc_id)""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and occurring items of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, found = decontamination.matches(docs, table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(found["matches"]["item_id"]))
    return out.select("doc_id", found["n_words"].alias("n_words"), decontamination.n_hit(found).alias("n_hit"),
                      F.size(items).cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
                      decontamination.contaminated(found).alias("contaminated"))


@query("op3_simhash_bk_trees")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


@query("op10_repeated_phrases", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM w WHERE len(w) >= 13)),
firsts AS (SELECT gram, min(doc_id) AS first FROM grams GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p
  FROM (SELECT g.doc_id, g.p FROM grams g JOIN firsts f USING (gram) WHERE f.first < g.doc_id)),
kept AS (
  SELECT a.doc_id, count(g.p) AS n_removed, string_agg(a.word, ' ' ORDER BY a.p) FILTER (WHERE g.p IS NULL) AS kept
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w) a
  LEFT JOIN gone g ON g.doc_id = a.doc_id AND g.p = a.p GROUP BY 1)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN kept k USING (doc_id)""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed from every document, and a digest of the rest."""
    return phrases.remove_repeats(table(spark, sf_dir, "documents"), ("doc_id", "n_words", "n_removed", "kept_sha256"))


@query("op8_assignment_lexer")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    out, found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def joined(items):
        return F.array_join(F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def n(kind):
        return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter(found, lambda s: s["kind"] != "literal")
    return out.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(base), 256).alias("base_sha256"),
                      joined(found).alias("spans"), n("literal"))


@query("op4_text_to_tag_ratio")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", html.extract(F.col("html")).alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("bigint"))


@query("op7_attention_mil")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = mil.fit(docs, table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", mil.held_out(F.col("doc_id")).alias("held_out"), mil.scored(model, docs).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= mil.THRESHOLD).cast("int"))


@query("op5_multi_index_hashing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest vectors of every fiftieth one."""
    vectors = table(spark, sf_dir, "embeddings")
    return hashing.nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5)


@query("op9_reply_trees", r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
safe AS (
  SELECT *, replace(replace(replace(replace(replace(text, '\', '\b'), '<s>', '\1'), '</s>', '\2'), '[INST]', '\3'), '[/INST]', '\4') AS body,
    replace(replace(replace(replace(replace(replace(role, '\', '\b'), '<s>', '\1'), '</s>', '\2'), '[INST]', '\3'), '[/INST]', '\4'), chr(10), '\n') AS name
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(name) + length(body) + 8) AS BIGINT) AS formatted_chars
FROM safe GROUP BY conv_id""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its formatted text."""
    probe = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    out = chat.format_branches(chat.replies(rows))
    out = out.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
                     chat.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return out.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
                      F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                      F.length("formatted").cast("bigint").alias("formatted_chars"))


def captures(pages: DataFrame) -> DataFrame:
    """Archive records of the pages: each is fetched, some change, and crawls that found nothing new follow.

    The times, tags and addresses of the records follow from page_id, so that every case (weak and stale tags, dates only,
    no validator, a change in between) occurs at all sizes.
    """
    page, url = F.col("page_id"), F.col("url")
    at = (page * 7919 % 1000003) * 1_000_000
    etag = F.when(page % 4 != 3, F.concat(F.lit('"'), F.substring(F.md5(F.col("html").cast("binary")), 1, 16), F.lit('"')))
    modified = F.when(page % 5 != 4, F.concat(F.lit("t"), (page % 1000).cast("string")))

    def fields(**values):
        return F.array(*[F.struct(F.lit(k.replace("_", "-")).alias("name"), v.cast("string").alias("value")) for k, v in values.items()])

    def record(when, number, address, later, kind, tag, date, headers, digest):
        body = F.struct((page * 10 + number).alias("record_id"), address.alias("url"), (at + later).alias("at"), F.lit(kind).alias("type"),
                        tag.alias("etag"), date.alias("last_modified"), headers.alias("headers"), digest.alias("digest"))
        return F.when(when, body)

    def response(when, number, later, tag, digest):
        head = fields(Cache_Control=F.lit("max-age=60"), Content_Length=F.length("html"), Content_Type=F.lit("text/html"), Date=at + later)
        return record(when, number, url, later, "response", tag, modified, head, digest)

    def revisit(when, number, address, later):
        tag = F.when(page % 7 == 0, F.lit('"stale"')).when(etag.isNotNull(), F.concat(F.lit("W/"), etag))
        head = fields(Cache_Control=F.lit("max-age=120"), Content_Length=F.lit(0), Date=at + later, X_Cache=F.lit("HIT"))
        return record(when, number, address, later, "revisit", tag, modified, head, F.lit(None).cast("string"))

    hour, digest = 3_600_000_000, F.md5(F.col("html").cast("binary"))
    first = F.concat(F.regexp_replace(url, "^http://", "https://"), F.lit("#again"))
    second = F.concat(F.regexp_replace(url, "#.*$", ""), F.when(url.contains("?"), "&").otherwise("?"), F.lit("utm_source=x"))
    rows = F.array(response(F.lit(True), 0, 0, etag, digest), revisit(page % 3 != 0, 1, first, hour),
                   response(page % 6 == 1, 5, hour * 3 // 2, F.concat(F.lit('"v2-'), page.cast("string"), F.lit('"')),
                            F.md5(F.concat(F.lit("v2"), F.col("html")).cast("binary"))),
                   revisit(page % 3 == 1, 2, second, 2 * hour))
    return pages.select(F.explode(F.array_compact(rows)).alias("r")).select("r.*")


@query("op2_revisit_resolution", r"""
WITH base AS (
  SELECT page_id, url, html, (page_id * 7919 % 1000003) * 1000000 AS captured_at,
    CASE WHEN page_id % 4 <> 3 THEN '"' || substr(md5(html), 1, 16) || '"' END AS etag,
    CASE WHEN page_id % 5 <> 4 THEN 't' || (page_id % 1000) END AS lm FROM pages),
responses AS (
  SELECT page_id * 10 AS record_id, url, captured_at, etag, lm, length(html) AS size, md5(html) AS digest FROM base
  UNION ALL SELECT page_id * 10 + 5, url, captured_at + 5400000000, '"v2-' || page_id || '"', lm, length(html), md5('v2' || html) FROM base WHERE page_id % 6 = 1),
tags AS (SELECT *, CASE WHEN page_id % 7 = 0 THEN '"stale"' WHEN etag IS NOT NULL THEN 'W/' || etag END AS tag FROM base),
revisits AS (
  SELECT page_id * 10 + 1 AS record_id, regexp_replace(url, '^http://', 'https://') || '#again' AS url, captured_at + 3600000000 AS captured_at, tag, lm
  FROM tags WHERE page_id % 3 <> 0
  UNION ALL SELECT page_id * 10 + 2, regexp_replace(url, '#.*$', '') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_source=x',
    captured_at + 7200000000, tag, lm FROM tags WHERE page_id % 3 = 1),
rest AS (
  SELECT true AS answer, record_id, captured_at, etag, lm, size, digest, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM responses
  UNION ALL SELECT false, record_id, captured_at, tag, lm, NULL, NULL, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') FROM revisits),
parts AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www[0-9]*\.', '')
      || regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '') AS place,
    regexp_extract(u, '^[^?]*\?(.*)$', 1) AS query FROM rest),
params AS (
  SELECT answer, record_id, string_agg(p, '&' ORDER BY p) AS q
  FROM (SELECT answer, record_id, unnest(string_split(query, '&')) AS p FROM parts)
  WHERE p <> '' AND NOT regexp_matches(lower(p), '^(utm_[^=]*|gclid|fbclid|sessionid|phpsessionid|ref)(=.*)?$') GROUP BY 1, 2),
located AS (SELECT p.*, p.place || coalesce('?' || m.q, '') AS canonical_url FROM parts p LEFT JOIN params m USING (answer, record_id)),
ranked AS (
  SELECT v.record_id, v.canonical_url, v.captured_at, v.etag AS tag, v.lm AS vlm, r.record_id AS response_id, r.etag, r.lm, r.size, r.digest,
    row_number() OVER (PARTITION BY v.record_id ORDER BY r.captured_at DESC, r.record_id DESC) AS k
  FROM (SELECT * FROM located WHERE NOT answer) v
  LEFT JOIN (SELECT * FROM located WHERE answer) r ON r.canonical_url = v.canonical_url AND r.captured_at < v.captured_at),
judged AS (
  SELECT *, CASE WHEN response_id IS NULL THEN 'missing'
      WHEN tag IS NOT NULL THEN CASE WHEN regexp_replace(tag, '^W/', '') = coalesce(etag, '') THEN 'resolved' ELSE 'mismatch' END
      WHEN vlm IS NOT NULL THEN CASE WHEN vlm = coalesce(lm, '') THEN 'resolved' ELSE 'mismatch' END
      ELSE 'unvalidated' END AS outcome FROM ranked WHERE k = 1)
SELECT record_id, canonical_url, captured_at, outcome,
  CASE WHEN outcome IN ('resolved', 'unvalidated') THEN response_id END AS response_id,
  CASE WHEN outcome IN ('resolved', 'unvalidated') THEN digest END AS digest,
  'Cache-Control: max-age=120' || chr(10) || CASE WHEN outcome IN ('resolved', 'unvalidated')
    THEN 'Content-Length: ' || size || chr(10) || 'Content-Type: text/html' || chr(10) || 'Date: ' || captured_at
    ELSE 'Content-Length: 0' || chr(10) || 'Date: ' || captured_at || chr(10) || 'X-Cache: HIT' END AS headers
FROM judged""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit with the response that it confirms."""
    found = warc.resolve(captures(table(spark, sf_dir, "pages")))
    return found.withColumn("headers", warc.header_text(F.col("headers"))).withColumnRenamed("at", "captured_at")


@query("op6_temperature_mixing", r"""
WITH RECURSIVE rows AS (
  SELECT DISTINCT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
src AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS n FROM rows GROUP BY 1 HAVING sum(n_tokens) > 0),
tot AS (SELECT CAST(sum(n) AS DOUBLE) AS total, count(*) AS k FROM src),
logs AS (SELECT ln(n / total) AS l FROM src, tot),
cube AS (SELECT list(l) AS ls FROM logs),
one(i, lo, hi) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM (
    SELECT i, lo, hi, mid, ln(z) - mid * zl / z >= 0.95::DOUBLE * ln(k) - 1e-12 AS ok FROM (
      SELECT i, lo, hi, mid, k, list_sum(list_transform(ls, lambda x: exp(mid * x))) AS z, list_sum(list_transform(ls, lambda x: exp(mid * x) * x)) AS zl
      FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid, ls, k FROM one, cube, tot WHERE i < 36)))),
t1 AS (SELECT round(lo, 6) AS t FROM one WHERE i = 36),
two(i, lo, hi) AS (
  SELECT 0, t, CAST(1 AS DOUBLE) FROM t1
  UNION ALL SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM (
    SELECT i, lo, hi, mid, list_max(list_transform(ls, lambda x: exp((mid - 1) * x))) / list_sum(list_transform(ls, lambda x: exp(mid * x))) > 4 AS ok
    FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid, ls FROM two, cube WHERE i < 36))),
t2 AS (
  SELECT CASE WHEN (SELECT max(exp((t - 1) * l)) / sum(exp(t * l)) FROM logs) > 4 THEN (SELECT round(lo, 6) FROM two WHERE i = 36) ELSE t END AS t FROM t1),
z AS (SELECT sum(exp(t * l)) AS z FROM logs, t2),
given AS (SELECT source, n, CAST(floor(round(exp(t * ln(n / total)) / z, 9) * total) AS BIGINT) AS quota, CAST(total AS BIGINT) AS budget FROM src, tot, t2, z),
copies AS (
  SELECT r.*, n, quota, greatest(1, (budget + 1048575) // 1048576) AS blocks, unnest(range(0, quota // n + 1)) AS epoch
  FROM rows r JOIN given g ON r.source IS NOT DISTINCT FROM g.source),
placed AS (SELECT *, md5(concat_ws(':', 'mix', epoch, coalesce(CAST(doc_id AS VARCHAR), 'null'))) AS place FROM copies),
summed AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY place, n_tokens, text ROWS UNBOUNDED PRECEDING) AS until FROM placed)
SELECT doc_id, source, n_tokens, epoch, CAST(least((epoch * n + until - n_tokens) * blocks // quota, blocks - 1) AS BIGINT) AS block, place
FROM summed WHERE epoch * n + until <= quota""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of the documents: every copy with its epoch, block and place."""
    return mixing.listing(table(spark, sf_dir, "documents")).drop("text_hash")


@query("op11_nonnegative_pu")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", mil.held_out(F.col("doc_id")).alias("held_out"), toxicity.scored(model, docs).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


@query("op12_polarisation_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen whitened components of every vector."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query("op13_k2_treap", r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, w, len(w) AS n
  FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents)
  WHERE len(w) > 0),
totals AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM d),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE item_id IS NOT NULL),
tf AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d)
  WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * df + 1))) AS BIGINT) AS weight
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), totals),
scores AS (
  SELECT a.item_id, d.doc_id, d.r,
         CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM asked a JOIN weights USING (term) JOIN tf USING (term) JOIN d USING (r), totals GROUP BY 1, 2, 3)
SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM scores WHERE score > 0)
WHERE k <= 10""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best documents of every benchmark item."""
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
