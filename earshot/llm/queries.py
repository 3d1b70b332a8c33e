"""The training-data operators as queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.llm import bytebpe
from earshot.llm.common import read_table
from earshot.llm.forest import near_vectors
from earshot.llm.html import extract
from earshot.llm.jaccard import jaccard_join
from earshot.llm.kdmeans import cluster
from earshot.llm.lexical import LOWER as _LOWER
from earshot.llm.lexical import TERM, build_index, search
from earshot.llm.lexical import UPPER as _UPPER
from earshot.llm.mixing import mix
from earshot.llm.packing import pack
from earshot.llm.quality import quality
from earshot.llm.syncmers import fingerprint_edits
from earshot.llm.token_counts import context_limits, length_histogram, token_lengths
from earshot.llm.toxicity import toxicity
from earshot.llm.urls import judge_urls


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: Fixed values of the query: (host, path, verdict).
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

#: How much likelier a document is to be in the drawn part of its source: by the binary digits of its size.
PREFERENCE = "length(bin(size))"


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read_table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity(docs, read_table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    lengths = token_lengths(docs, vocabulary("byte_bpe_50k.tiktoken"), keep=("lang",))
    return context_limits(length_histogram(lengths, "lang")).withColumnRenamed("grp", "lang")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs, preference=PREFERENCE).select("doc_id", "size", "source_size", "target", "taken")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.sql(f"SELECT * FROM VALUES {_RULES} AS rules(host, path, verdict)")
    return judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(read_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality(docs, read_table(spark, sf_dir, "labels")).select("doc_id", "quality_score", "keep")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(read_table(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(read_table(spark, sf_dir, "documents"))
    return search(index, read_table(spark, sf_dir, "benchmark"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = vocabulary("byte_bpe_50k.tiktoken")
    encoded = bytebpe.encode(read_table(spark, sf_dir, "documents"), ranks)
    named = encoded.withColumn("ids_sha256", F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)).drop("offsets")
    return bytebpe.decode(named, ranks).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_html_extraction": op2_html_extraction,
    "op3_toxicity": op3_toxicity,
    "op4_token_counts": op4_token_counts,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_packing": op6_packing,
    "op7_mixing": op7_mixing,
    "op8_url_filter": op8_url_filter,
    "op9_fingerprints": op9_fingerprints,
    "op10_quality": op10_quality,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_lexical_search": op12_lexical_search,
    "op13_byte_bpe": op13_byte_bpe,
}
_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)


def _kmeans_sql(k: int = 40, rounds: int = 5, seed: int = 2, scale: int = 256, dim: int = 64) -> str:
    """Lloyd's rounds written out one after the other; distances by inner products, exact in doubles below 2^53."""
    far = "(p.sq - 2 * list_inner_product(p.x, c.x) + list_inner_product(c.x, c.x))::BIGINT"
    ctes = [f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, x, list_inner_product(x, x) AS sq FROM (
    SELECT vec_id, [floor(v::DOUBLE * {scale}) FOR v IN embedding] AS x FROM embeddings
    WHERE len(embedding) = {dim} AND len([v FOR v IN embedding IF v IS NOT NULL AND isfinite(v)]) = {dim})),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, x) - 1 AS c, x FROM (SELECT sha256('{seed}:' || vec_id) AS h, x FROM kept) ORDER BY c LIMIT {k}),
wide AS MATERIALIZED (SELECT r, unnest(x) AS v, generate_subscripts(x, 1) AS d FROM kept)"""]
    for i in range(rounds + 1):
        ctes.append(f"a{i} AS MATERIALIZED (SELECT r, b.d AS distance, b.c AS c FROM (SELECT p.r, min({{'d': {far}, 'c': c.c}}) AS b FROM kept p, c{i} c GROUP BY p.r))")
        if i < rounds:
            ctes.append(f"""m{i} AS (SELECT c, list(m ORDER BY d) AS x FROM (SELECT c, d, floor(sum(v) / count(*)) AS m FROM a{i} JOIN wide USING (r) GROUP BY c, d) GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.x, o.x) AS x FROM c{i} o LEFT JOIN m{i} m ON o.c = m.c)""")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT vec_id, a.c::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(f.x::BIGINT[], ',')) AS centroid_sha256
FROM kept JOIN a{rounds} a USING (r) JOIN c{rounds} f ON f.c = a.c"""


#: What the others compute (tokenizers, trained models, random trees and paths, fingerprints) is beyond SQL.
ORACLES: dict[str, str] = {
    "op7_mixing": r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size, sum(size * length(bin(size)))::DOUBLE AS preferred, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM sized GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][(n - 1) % 3 + 1]::DOUBLE AS weight, (source_size * 3)::DOUBLE AS bound FROM totals),
levels AS (
  SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(bound) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level FROM weighed
  WINDOW w AS (ORDER BY bound / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
one AS (SELECT level FROM levels WHERE level * weight <= bound ORDER BY bound / weight, n LIMIT 1),
targets AS (SELECT source, source_size, preferred, least(bound, weight * (SELECT level FROM one)) AS target FROM weighed),
due AS (SELECT *, least(floor(coalesce(target / nullif(source_size, 0), 0) + 1e-9), 3)::BIGINT AS base FROM targets),
rests AS (SELECT *, CASE WHEN base >= 3 THEN 0::DOUBLE ELSE greatest(target - base * source_size, 0) END AS rest FROM due),
ranked AS (
  SELECT s.doc_id, s.size, r.*, length(bin(s.size)) * coalesce(rest / nullif(preferred, 0), 0) AS p, s.u FROM sized s JOIN rests r ON s.source IS NOT DISTINCT FROM r.source),
odds AS (SELECT *, CASE WHEN p >= 1 THEN 0 WHEN p <= 0 THEN NULL ELSE u / (1 - u) * (1 - p) / p END AS q FROM ranked),
summed AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q NULLS LAST RANGE UNBOUNDED PRECEDING) AS upto FROM odds),
cut AS (SELECT source, coalesce(max(upto) FILTER (upto <= rest AND q IS NOT NULL), 0) AS words FROM summed GROUP BY source),
chosen AS (SELECT s.*, s.rest - c.words AS room, s.upto <= s.rest AND s.q IS NOT NULL AS first FROM summed s JOIN cut c ON s.source IS NOT DISTINCT FROM c.source),
closest AS (
  SELECT source, q, size, room, gap FROM (SELECT *, abs(room - size) AS gap, row_number() OVER (PARTITION BY source ORDER BY abs(room - size), q NULLS LAST, size) AS k
    FROM chosen WHERE NOT first AND size > 0 AND abs(room - size) < room) WHERE k = 1),
ends AS (SELECT c.source, any_value(room) AS room, min(c.size) FILTER (NOT first AND c.q IS NOT NULL AND c.size > 0) AS least FROM chosen c GROUP BY c.source),
missed AS (SELECT e.source, e.least, e.room, abs(e.room - coalesce(c.size, 0)) AS miss FROM ends e LEFT JOIN closest c ON e.source IS NOT DISTINCT FROM c.source),
line AS (SELECT source, doc_id, q, size, row_number() OVER (PARTITION BY source ORDER BY q, doc_id) AS n FROM odds WHERE q IS NOT NULL AND size > 0),
walk(source, n, room, took, doc_id) AS (
  SELECT source, 0::BIGINT, rest, false, NULL::BIGINT FROM rests
  UNION ALL SELECT w.source, l.n, CASE WHEN l.size <= w.room THEN w.room - l.size ELSE w.room END, l.size <= w.room, l.doc_id::BIGINT
  FROM walk w JOIN line l ON l.source IS NOT DISTINCT FROM w.source AND l.n = w.n + 1),
walked AS (SELECT source, min(room) AS room FROM walk GROUP BY source),
behind AS (SELECT c.* EXCLUDE (room, first), w.room, t.doc_id IS NOT NULL AS first FROM chosen c JOIN walked w ON c.source IS NOT DISTINCT FROM w.source
  LEFT JOIN (SELECT source, doc_id FROM walk WHERE took) t ON c.source IS NOT DISTINCT FROM t.source AND c.doc_id = t.doc_id),
closest_behind AS (
  SELECT source, q, size, room, gap FROM (SELECT *, abs(room - size) AS gap, row_number() OVER (PARTITION BY source ORDER BY abs(room - size), q NULLS LAST, size) AS k
    FROM behind WHERE NOT first AND size > 0 AND abs(room - size) < room) WHERE k = 1),
by_walk AS (
  SELECT m.source, coalesce(m.least <= m.room AND m.miss >= m.least AND coalesce(c.gap, w.room) <= m.miss, false) AS yes
  FROM missed m JOIN walked w ON m.source IS NOT DISTINCT FROM w.source LEFT JOIN closest_behind c ON m.source IS NOT DISTINCT FROM c.source),
drawn AS (
  SELECT c.* FROM chosen c JOIN by_walk b ON c.source IS NOT DISTINCT FROM b.source AND NOT b.yes
  UNION ALL BY NAME SELECT c.* FROM behind c JOIN by_walk b ON c.source IS NOT DISTINCT FROM b.source AND b.yes),
extra AS (
  SELECT c.* FROM closest c JOIN by_walk b ON c.source IS NOT DISTINCT FROM b.source AND NOT b.yes
  UNION ALL BY NAME SELECT c.* FROM closest_behind c JOIN by_walk b ON c.source IS NOT DISTINCT FROM b.source AND b.yes),
numbered AS (SELECT *, row_number() OVER (PARTITION BY source, q, size) AS k FROM drawn)
SELECT c.doc_id, c.size, c.source_size, c.target, (least(base + (first OR e.size IS NOT NULL)::BIGINT, 3) * c.size)::BIGINT AS taken
FROM numbered c LEFT JOIN extra e ON c.source IS NOT DISTINCT FROM e.source AND c.q IS NOT DISTINCT FROM e.q AND c.size = e.size AND c.k <= greatest(floor(e.room / e.size + 0.5), 1)""",
    "op8_url_filter": f"""
WITH rules(rh, rp, v) AS (VALUES {_RULES}),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM rest),
fits AS (SELECT host, path, rh || rp AS rule, v, row_number() OVER (PARTITION BY host, path ORDER BY length(rh || rp) DESC, length(rh) DESC) AS k
  FROM (SELECT DISTINCT host, path FROM parts) p JOIN rules r ON (p.host = rh OR ends_with(p.host, '.' || rh)) AND starts_with(p.path, rp))
SELECT page_id, p.host, p.path, f.rule, coalesce(f.v, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON p.host = f.host AND p.path = f.path AND f.k = 1""",
    "op11_centroid_clustering": _kmeans_sql(),
    "op12_lexical_search": f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{TERM}') AS terms FROM documents),
stats AS (SELECT count(*) FILTER (len(terms) > 0) AS n, sum(len(terms))::BIGINT AS l FROM docs),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{TERM}')) AS term FROM benchmark),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM docs) GROUP BY r, term),
weights AS (SELECT term, floor(1000 * ln((2 * (SELECT n FROM stats) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf GROUP BY term),
sized AS (SELECT r, doc_id, 50 + (50 * len(terms) * (SELECT n FROM stats)) // (SELECT l FROM stats) AS m FROM docs WHERE len(terms) > 0),
scored AS (
  SELECT item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN sized USING (r) GROUP BY item_id, doc_id, r)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0) WHERE rank <= 50""",
}
