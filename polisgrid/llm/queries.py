"""The thirteen operators as queries over the driver's tables, with their production parameters."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from polisgrid.llm import bpe, decontaminate, divergence, filters, itq, language, minhash, ngram, quality, records, secrets, toxicity, warc
from polisgrid.llm.shared import read


@functools.cache
def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.token_records(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), pattern())


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(read(spark, sf_dir, "documents"))


def op5_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_vectors(read(spark, sf_dir, "embeddings"))


def op6_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.score(read(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(read(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(read(spark, sf_dir, "documents"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_token_records, op2_byte_bpe, op3_minhash, op4_secrets, op5_itq, op6_ngram, op7_toxicity, op8_language, op9_decontaminate, op10_quality, op11_divergence, op12_warc, op13_filters)}
ORACLE_SQL: dict[str, str] = {
    "op3_minhash": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
 n AS MATERIALIZED (SELECT doc_id, len(s) AS n FROM s), f AS MATERIALIZED (SELECT doc_id, unnest(s) AS x FROM s),
 c AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM f p JOIN f q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY 1, 2),
 l AS MATERIALIZED (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
 e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
 SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r.b) AS component_id, n.doc_id = min(r.b) AS kept FROM n JOIN r ON n.doc_id = r.a GROUP BY n.doc_id, n.n""",
    "op5_itq": """WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 l AS MATERIALIZED (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id <> q.vec_id WHERE list_cosine_similarity(p.e, q.e) >= 0.9),
 r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
 n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
 SELECT v.vec_id, coalesce(any_value(n.n), 0) AS n_links, min(r.b) AS component_id, v.vec_id = min(r.b) AS kept FROM v JOIN r ON v.vec_id = r.a LEFT JOIN n ON n.a = v.vec_id GROUP BY v.vec_id""",
    "op11_divergence": r"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
 t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
 k AS MATERIALIZED (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
 v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
 g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
 c AS MATERIALIZED (SELECT g.lang, g.source, k.term, count(t.term) AS n FROM g JOIN k USING (lang) LEFT JOIN t ON t.lang = g.lang AND t.source = g.source AND t.term = k.term GROUP BY ALL),
 p AS MATERIALIZED (SELECT lang, source, term, n, 1 + CAST(1000000000 AS HUGEINT) * (n + 5) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM c JOIN v USING (lang)),
 q AS MATERIALIZED (SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (n + 5) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) JOIN v USING (lang)),
 pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(sum(abs(x.p - y.p)), 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
 terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
 SELECT * FROM r WHERE part = 'pair' OR rank <= 50""",
    "op12_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), d AS (SELECT page_id, html, strlen(html) AS n, CAST(CAST(unhex(sha1(html)) AS BIT) AS VARCHAR) AS bits, max(page_id) OVER (PARTITION BY html) AS latest FROM p)
 SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(5), lambda b: CAST(substr(bits, 5 * k + b + 1, 1) AS INTEGER) << CAST(4 - b AS INTEGER))) AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN latest IS NULL OR page_id IS NOT DISTINCT FROM latest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM latest THEN latest END AS refers_to FROM d""",
    "op13_filters": r"""WITH RECURSIVE t AS MATERIALIZED (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
 w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM t),
 m AS (SELECT text, min(doc_id) AS least FROM t GROUP BY text),
 g AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
 f AS MATERIALIZED (SELECT part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * length(text))::INT
  + 8 * (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 1 ELSE 0 END) + 16 * (CASE WHEN w.doc_id > least THEN 1 ELSE 0 END) AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM w JOIN m USING (text) LEFT JOIN g USING (doc_id)),
 c AS MATERIALIZED (SELECT part, mask, good, toxic, count(*) AS n FROM f GROUP BY ALL),
 o AS (SELECT '' AS o UNION ALL SELECT o || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(o, x)),
 s AS (SELECT o AS filter_order, step, substring(o, step, 1) AS f, 1 << (instr('ABCDE', substring(o, step, 1)) - 1) AS bit, list_sum(list_transform(range(1, step), lambda k: 1 << (instr('ABCDE', substring(o, k, 1)) - 1))) AS past
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step) WHERE length(o) = 5),
 x AS (SELECT *, mask & bit AS hit, mask & CAST(coalesce(past, 0) AS INTEGER) AS gone FROM c, s),
 r AS MATERIALIZED (SELECT part, filter_order, f, CAST(step AS INTEGER) AS step, coalesce(sum(n) FILTER (hit = 0 AND gone = 0), 0) AS kept, coalesce(sum(n) FILTER (hit > 0 AND gone = 0), 0) AS removed, coalesce(sum(n) FILTER (hit > 0 AND gone > 0), 0) AS redundant,
  coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails, coalesce(sum(n) FILTER (hit > 0 AND gone = 0 AND good = 1), 0) AS good_lost, coalesce(sum(n) FILTER (hit > 0 AND gone = 0 AND toxic = 1), 0) AS toxic_lost FROM x GROUP BY ALL)
 SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r""",
}
