"""The thin queries of the training-data operators: whole tables, production parameters, contract columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, centroids, decontam, html_extract, langid, line_dedup, minhash, ngram_join, runs, secret_scan, token_count, token_store, topk
from tessera.llm.common import shared_path, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, threshold=85)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_classes(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"] != "opaque")
    live = F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"), live)


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.bpe_encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    digits = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_count.unigram_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return token_count.token_counts(table(spark, sf_dir, "documents"), pieces)


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    token_store.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    rows = token_store.with_crc32(token_store.read_tokens(spark, path))
    return token_store.with_start(rows, path).select("doc_id", "start", F.col("n_tokens").cast("long").alias("n_tokens"), "ids_crc32")


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(~F.coalesce(held_out(), F.lit(False))))
    return langid.identify(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.inline("hits"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_sets(table(spark, sf_dir, "documents"))


def made_periodic(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents, told by crc32 of the id, repeats a stretch of its words from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    rows = docs.select("doc_id", "text", h.alias("h"), words.alias("words")).withColumn("n", F.size("words")).withColumn("g", F.expr("h DIV 10"))
    rows = rows.withColumn("a", F.expr("CAST(g % greatest(n, 1) AS INT)")).withColumn("p", F.expr("CAST(1 + (n - a) DIV (3 + g % 8) AS INT)"))
    cycle = F.flatten(F.expr("array_repeat(slice(words, a + 1, p), CAST(ceil((n - a) / p) AS INT))"))
    made = F.array_join(F.concat(F.expr("slice(words, 1, a)"), F.slice(cycle, F.lit(1), F.col("n") - F.col("a"))), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.summary(runs.periodic_runs(made_periodic(table(spark, sf_dir, "documents"))))


def queries() -> dict[str, Query]:
    found = (op1_minhash, op2_line_dedup, op3_secret_scan, op4_html_extract, op5_bpe, op6_token_count, op7_token_output, op8_langid, op9_topk, op10_decontam, op11_centroids, op12_ngram_join, op13_runs)
    return {f.__name__: f for f in found}


#: Linked documents are closed over by a recursive walk of minima; sets of three-word shingles as the contract has them.
OP1_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS m, any_value(b.n) AS n, count(*) AS c
  FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common WHERE 100 * c >= 85 * (m + n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id, doc_id AS c FROM sets
  UNION
  SELECT b.y, r.c FROM reach r JOIN both_ways b ON b.x = r.doc_id WHERE r.c < b.y)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, r.c AS component_id, s.doc_id = r.c AS kept
FROM sets s JOIN (SELECT doc_id, min(c) AS c FROM reach GROUP BY 1) r USING (doc_id)
"""

#: As OP1_SQL, with sets of five-word shingles at 80.
OP12_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS m, any_value(b.n) AS n, count(*) AS c
  FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common WHERE 100 * c >= 80 * (m + n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS c FROM sets UNION SELECT b.y, r.c FROM reach r JOIN both_ways b ON b.x = r.doc_id WHERE r.c < b.y)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, r.c AS component_id FROM sets s JOIN (SELECT doc_id, min(c) AS c FROM reach GROUP BY 1) r USING (doc_id)
"""

#: DuckDB measures bytes: the accented letters of the documents' four languages stand as single control characters.
ACCENTS = "óñÓíÑÍÊéèêçÈÉÇößäüÖÜÄ"
_AS_BYTES = "translate(line, '" + ACCENTS + "', " + " || ".join(f"chr({i})" for i in [*range(1, 9), *range(14, 27)]) + ")"
_TRIMMED = "trim(string_split(text, chr(10))[i], " + " || ".join(f"chr({ord(c)})" for c in line_dedup.WHITE) + ")"

#: Letters are counted first, so that few pairs are measured; classes as in OP1_SQL.
OP2_SQL = f"""
WITH RECURSIVE places AS (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL),
lines AS (SELECT * FROM (SELECT doc_id, i - 1 AS line_no, {_TRIMMED} AS line FROM places) WHERE line <> ''),
nodes AS MATERIALIZED (
  SELECT line, length(line) AS n, (length(line) + 30) // 50 AS most, {_AS_BYTES} AS t, min(doc_id * 1000000 + line_no) AS p,
    list_transform(['a', 'd', 'e', 'h', 'i', 'n', 'o', 'r', 's', 't', 'u', ' ', ',', '.', 'c', 'l'], lambda c: length(line) - length(replace(line, c, ''))) AS k FROM lines GROUP BY line),
links AS MATERIALIZED (
  SELECT a.p AS x, b.p AS y FROM nodes a JOIN nodes b ON b.n >= a.n AND b.n <= a.n + a.most AND (b.n > a.n OR b.p > a.p)
  WHERE a.most > 0 AND CASE WHEN list_sum(list_transform(list_zip(a.k, b.k), lambda z: greatest(z[1] - z[2], 0))) <= a.most AND list_sum(list_transform(list_zip(a.k, b.k), lambda z: greatest(z[2] - z[1], 0))) <= a.most
    THEN levenshtein(a.t, b.t) <= a.most ELSE false END),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT p, p AS c FROM nodes UNION SELECT b.y, r.c FROM reach r JOIN both_ways b ON b.x = r.p WHERE r.c < b.y),
firsts AS (SELECT line, c FROM nodes JOIN (SELECT p, min(c) AS c FROM reach GROUP BY 1) USING (p))
SELECT doc_id, line_no::INTEGER AS line_no, c // 1000000 AS class_doc, (c % 1000000)::INTEGER AS class_line, doc_id * 1000000 + line_no = c AS kept FROM lines JOIN firsts USING (line)
"""

def _found(k: int, kind: str, pattern: str, group: int, holds: str) -> str:
    """Spans of one kind: the texts between the matches give the places."""
    p = "'" + pattern.replace("'", "''") + "'"
    begin = "list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)"
    return f"""SELECT doc_id, source, {k} AS k, '{kind}' AS kind, f.a::BIGINT AS a, (f.a + length(f.m))::BIGINT AS e, f.v AS v FROM (
      SELECT doc_id, source, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'a': {begin}, 'm': m[i], 'v': v[i]}})) AS f FROM (
        SELECT doc_id, source, regexp_extract_all(text, {p}) AS m, regexp_extract_all(text, {p}, {group}) AS v, string_split_regex(text, {p}) AS s FROM docs)) WHERE {holds}"""


_ENTROPY = "list_sum(list_transform(map_values(list_histogram(string_split(f.v, ''))), lambda c: -(c / length(f.v)) * log2(c / length(f.v))))"

OP3_SQL = f"""
WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
base AS MATERIALIZED (
  {_found(0, "assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, "length(f.v) >= 6")}
  UNION ALL {_found(1, "access", "AKIA[A-Z0-9]+", 0, "length(f.v) >= 20")}
  UNION ALL {_found(2, "hex", "[0-9a-f]+", 0, "length(f.v) >= 24")}),
opaque AS ({_found(3, "opaque", "[A-Za-z0-9+/_=-]" + "{20,}", 0, "regexp_matches(f.v, '[0-9]') AND regexp_matches(f.v, '[A-Za-z]') AND " + _ENTROPY + " >= 3.0")}),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM opaque o WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = o.doc_id AND b.a < o.e AND o.a < b.e)),
owners AS (SELECT v, count(DISTINCT coalesce('=' || source, '')) AS n FROM spans GROUP BY v),
told AS (SELECT spans.*, n <= 2 AS live, kind || ':' || a || ':' || e AS t FROM spans JOIN owners USING (v) WHERE k < 3 OR n <= 2),
rows AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, coalesce(string_agg(t, ',' ORDER BY a, k) FILTER (k < 3), '') AS base, string_agg(t, ',' ORDER BY a, k) AS spans, count(*) FILTER (live) AS n_live FROM told GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live FROM docs LEFT JOIN rows USING (doc_id)
"""

OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""


def op11_sql(rounds: int = 10) -> str:
    """Each round's assignment and centroids as tables; DuckDB's // cuts towards zero, so floors are written out."""
    nearest = "SELECT v.id, v.q, arg_min(c.n, (list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, c.n)) AS n FROM v, c{0} c GROUP BY v.id, v.q"
    parts = ["""v AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS n, q FROM (SELECT sha256('3:' || vec_id) AS h, q FROM v ORDER BY h LIMIT 8))"]
    for r in range(rounds):
        parts.append(f"a{r} AS MATERIALIZED ({nearest.format(r)})")
        parts.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c.n, coalesce(m.q, c.q) AS q FROM c{r} c LEFT JOIN (
    SELECT n, list((s - ((s % k) + k) % k) // k ORDER BY i) AS q FROM (SELECT n, i, sum(x)::BIGINT AS s, count(*) AS k FROM (SELECT n, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{r}) GROUP BY n, i) GROUP BY n) m USING (n))""")
    parts.append(f"last AS MATERIALIZED ({nearest.format(rounds)})")
    parts.append(f"d AS (SELECT v.vec_id, c.n, list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d, sha256(array_to_string(c.q, ',')) AS h FROM last JOIN v USING (id) JOIN c{rounds} c ON c.n = last.n)")
    return "WITH " + ",\n".join(parts) + "\nSELECT vec_id, n::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY n))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256 FROM d"


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash": OP1_SQL, "op2_line_dedup": OP2_SQL, "op3_secret_scan": OP3_SQL, "op9_topk": OP9_SQL, "op11_centroids": op11_sql(), "op12_ngram_join": OP12_SQL}
