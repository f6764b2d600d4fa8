"""The opN queries over the shared tables and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlark.llm.centroids import cluster_vectors
from ledgerlark.llm.decontaminate import contamination
from ledgerlark.llm.language_id import document_languages, evidence_of_pages, identify
from ledgerlark.llm.licenses import scan_licenses
from ledgerlark.llm.ngram_join import jaccard_components
from ledgerlark.llm.packing import pack
from ledgerlark.llm.pii import find_personal_data
from ledgerlark.llm.quality import score_quality
from ledgerlark.llm.rp_forest import near_duplicates
from ledgerlark.llm.secrets import find_secrets
from ledgerlark.llm.spelling import group_variants
from ledgerlark.llm.url_rules import HOST_RULES, RULES, judge_urls
from ledgerlark.llm.warc import round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


QUERIES["op1_ngram_jaccard_join"] = op1
ORACLE["op1_ngram_jaccard_join"] = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM w
), n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT a AS d, b AS m FROM l UNION SELECT r.d, l.b FROM r JOIN l ON l.a = r.m)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(min(r.m), n.doc_id)) AS component_id
FROM n LEFT JOIN r ON r.d = n.doc_id GROUP BY n.doc_id, n.n
"""


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


QUERIES["op2_benchmark_decontamination"] = op2
_WORDS = "regexp_extract_all({0}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE["op2_benchmark_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
i AS (SELECT item_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM benchmark),
n AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda j: array_to_string(w[j:j + 12], ' '))) AS g FROM i WHERE len(w) > 0),
k AS (SELECT DISTINCT k FROM n),
o AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS p, w FROM d, k),
h AS (SELECT o.doc_id, o.p, o.k, n.item_id FROM o JOIN n ON n.k = o.k AND n.g = array_to_string(o.w[o.p:o.p + o.k - 1], ' ')),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS x FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(x, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES["op10_best_fit_packing"] = op10


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES["op7_embedding_near_dedup"] = op7
# All pairs: the tables this is held against are searched whole, in one leaf.
ORACLE["op7_embedding_near_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
f AS (SELECT vec_id, e, len(e) AS d FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, e, d, sqrt(list_inner_product(e, e)) AS n FROM f),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.d = b.d AND a.vec_id <> b.vec_id WHERE a.n > 0 AND b.n > 0 AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.9),
k AS (SELECT a, count(*) AS n FROM l GROUP BY 1), r AS (SELECT a AS x, b AS m FROM l UNION SELECT r.x, l.b FROM r JOIN l ON l.a = r.m),
c AS (SELECT x, min(m) AS m FROM r GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept
FROM v LEFT JOIN k ON k.a = vec_id LEFT JOIN c ON c.x = vec_id
"""


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


QUERIES["op5_warc_salvage"] = op5
ORACLE["op5_warc_salvage"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
b AS (SELECT page_id, h, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS top FROM p),
c AS (SELECT *, list_aggregate(list_transform(range(1, 41), lambda i: lpad(bin(strpos('0123456789abcdef', x[i]) - 1), 4, '0')), 'string_agg', '') AS bits FROM b)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + 16 * CAST(bits[5 * i + 1] AS INT) + 8 * CAST(bits[5 * i + 2] AS INT) + 4 * CAST(bits[5 * i + 3] AS INT) + 2 * CAST(bits[5 * i + 4] AS INT) + CAST(bits[5 * i + 5] AS INT) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM c
"""


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


QUERIES["op6_url_rules"] = op6
_fits = lambda verdict: "(" + " OR ".join(f"regexp_matches(v.host || v.path, '{r.pattern}')" for r in RULES if not r.rank and r.verdict == verdict) + ")"
_RULE_ROWS = ", ".join(f"('{v}', '{n}', '{n[: n.index('/')]}', '{n[n.index('/') :]}')" for v, n in HOST_RULES)
ORACLE["op6_url_rules"] = f"""
WITH r(verdict, rule, h, p) AS (VALUES {_RULE_ROWS}),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
v AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM u),
f AS (SELECT v.page_id, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
  FROM v JOIN r ON (v.host = r.h OR v.host LIKE '%.' || r.h) AND starts_with(v.path, r.p) GROUP BY 1)
SELECT v.page_id, coalesce(v.host, '') AS host, coalesce(v.path, '') AS path, f.rule, coalesce(f.verdict,
  CASE WHEN {_fits("allow")} THEN 'allow' WHEN {_fits("block")} THEN 'block' ELSE 'allow' END) AS verdict
FROM v LEFT JOIN f ON f.page_id = v.page_id
"""


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


QUERIES["op3_license_scan"] = op3


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES["op9_quality_classifier"] = op9


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


QUERIES["op4_personal_data"] = op4


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_languages(table(spark, sf_dir, "documents"))


QUERIES["op8_language_id"] = op8


def pages_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator on web pages, where markup, host and address suffix speak too."""
    return identify(evidence_of_pages(table(spark, sf_dir, "pages"))).withColumnRenamed("id", "page_id").drop("text_key")


QUERIES["language_of_pages"] = pages_language


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


QUERIES["op11_secret_scan"] = op11


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(table(spark, sf_dir, "documents"))


QUERIES["op12_spelling_variants"] = op12
# The checksum by its rule, bit by bit; near words by what is left when any one code point is left out.
ORACLE["op12_spelling_variants"] = f"""
WITH RECURSIVE crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
runs AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[a-z\u00C0-\u00FF]+')) AS r FROM documents WHERE text IS NOT NULL),
own AS (SELECT doc_id, r, count(*) AS n FROM runs WHERE length(r) >= 6 GROUP BY 1, 2),
h AS (SELECT r, n, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(doc_id || ':' || r, ''), lambda x: CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)] ELSE [195::BIGINT, ord(x) - 64] END))),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM own, crc),
f AS (SELECT CASE WHEN h % 199 = 0 THEN substring(r, 1, CAST(h % length(r) AS BIGINT)) || substring(r, CAST(h % length(r) AS BIGINT) + 2) ELSE r END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM f WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
d AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
o AS (SELECT DISTINCT word, n, i, substring(word, 1, i - 1) AS a, substring(word, i + 1) AS b FROM d),
p AS (SELECT x.word, y.word AS other, y.n AS other_n FROM o x JOIN o y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT o.word, w.word, w.n FROM o JOIN w ON w.word = o.a || o.b UNION SELECT w.word, o.word, o.n FROM o JOIN w ON w.word = o.a || o.b),
c AS (SELECT word, count(*) AS n_near, max(other_n) AS top FROM p GROUP BY 1),
m AS (SELECT c.word, c.n_near, c.top, min(encode(p.other)) AS first FROM c JOIN p ON p.word = c.word AND p.other_n = c.top GROUP BY ALL),
g AS (SELECT w.word, w.n, coalesce(m.n_near, 0) AS n_near, CASE WHEN m.top >= 5 * w.n THEN decode(m.first) END AS form, CASE WHEN m.top >= 5 * w.n THEN m.top END AS form_n FROM w LEFT JOIN m ON m.word = w.word),
up AS (SELECT word, word AS root, 0 AS step FROM g UNION ALL SELECT up.word, g.form, up.step + 1 FROM up JOIN g ON g.word = up.root WHERE g.form IS NOT NULL)
SELECT g.word, g.form, z.root, g.n, g.n_near, g.form_n FROM g JOIN (SELECT word, arg_max(root, step) AS root FROM up GROUP BY 1) z ON z.word = g.word
"""


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings")).drop("centroid", "cluster_size")


QUERIES["op13_centroid_clustering"] = op13


def _clustered(rounds: int = 3) -> str:
    """Every vector against every centroid, round after round."""
    nearest = """a{0} AS (SELECT vec_id, e, list_reduce(list(struct_pack(d := d, k := k) ORDER BY d, k)[1:1], lambda x, y: x) AS m FROM (
  SELECT v.vec_id, v.e, c.k, CAST(list_sum(list_transform(range(1, 65), lambda i: (v.e[i] - c.c[i]) * (v.e[i] - c.c[i]))) AS BIGINT) AS d FROM v, c{0} c) GROUP BY vec_id, e)"""
    moved = """s{1} AS (SELECT k, list(CAST((s - ((s % n + n) % n)) // n AS BIGINT) ORDER BY i) AS c FROM (SELECT m.k AS k, i, sum(e[i]) AS s, count(*) AS n FROM a{0}, range(1, 65) r(i) GROUP BY 1, 2) GROUP BY k),
c{1} AS (SELECT c{0}.k, coalesce(s{1}.c, c{0}.c) AS c FROM c{0} LEFT JOIN s{1} ON s{1}.k = c{0}.k)"""
    steps = ",\n".join(x.format(i, i + 1) for i in range(rounds) for x in (nearest, moved))
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k, e AS c FROM (SELECT * FROM v ORDER BY sha256('1:' || vec_id) LIMIT 16)),
{steps},
{nearest.format(rounds)}
SELECT vec_id, CAST(m.k AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.k) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.k = a.m.k
"""


ORACLE["op13_centroid_clustering"] = _clustered()
