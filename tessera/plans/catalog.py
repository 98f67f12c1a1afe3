"""The query catalogue: each operator applied to the star schema and the document tables, with its SQL."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import naming, phrases, prompts
from tessera.functions import text as X
from tessera.functions import vectors as V
from tessera.operators import cells, context, encoders, evaluation, fusion, graph, ingest, knowledge, models, overlaps, perception, runway, supervision, training, trends
from tessera.operators import triples as T
from tessera.operators import vectors as S
from tessera.sources import files, keyed_store, sinks
from tessera.sources.lines import read_lines
from tessera.sources.storage import built_once, materialise, shared_path, shuffle_partitions, stamp

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), "doc_id", "text", "source", "lang")


# -- documents ---------------------------------------------------------------------------------------------------

_NOISE = "(?i)" + "|".join(f"(?:{p})" for p in X.BOILERPLATE)
_TIDY = r"trim(regexp_replace(array_to_string(list_transform(string_split(regexp_replace({0}, '[ \t]+', ' ', 'g'), chr(10)), lambda l: trim(l)), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10))"
_LEFT = f"array_to_string(list_filter(string_split({_TIDY.format('text')}, chr(10)), lambda l: NOT regexp_matches(l, '{_NOISE}')), chr(10))"
_CLEAN = _TIDY.format(_LEFT)
_FLAT = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_WORDS = f"CASE WHEN {_FLAT.format('{0}')} = '' THEN 0 ELSE len(string_split({_FLAT.format('{0}')}, ' ')) END"
_HASH = f"sha1({_FLAT.format('lower({0})')})"
CLEAN_CTE = f"cleaned AS (SELECT doc_id, source, {_CLEAN} AS text FROM documents)"
KEPT_CTE = f"""{CLEAN_CTE}, gated AS (SELECT * FROM cleaned WHERE NOT (text = '' OR length(text) < 80 OR {_WORDS.format('text')} < 15)),
kept AS (SELECT doc_id, source, text FROM (SELECT *, row_number() OVER (PARTITION BY source, {_HASH.format('text')} ORDER BY doc_id) AS n FROM gated) WHERE n = 1)"""


@query(f"WITH {CLEAN_CTE} SELECT doc_id, sha1(text) AS text_sha1, length(text) AS n FROM cleaned")
def doc_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = documents(spark, sf_dir).select("doc_id", X.clean_text(F.col("text")).alias("text"))
    return cleaned.select("doc_id", F.sha1(F.col("text").cast("binary")).alias("text_sha1"), F.length("text").cast("long").alias("n"))


@query(f"SELECT doc_id, (text = '' OR length(text) < 80 OR {_WORDS.format('text')} < 15) AS low, {_WORDS.format('text')} AS words FROM documents")
def doc_quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", X.is_low_quality(F.col("text")).alias("low"), X.word_count(F.col("text")).cast("long").alias("words"))


@query(f"SELECT doc_id, {_HASH.format('text')} AS h FROM documents")
def doc_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", X.content_hash(F.col("text")).alias("h"))


@query(f"SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY {_HASH.format('text')} ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def doc_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.dedup_first(documents(spark, sf_dir).select("ord", "doc_id", "source", "text"), scope=()).select("doc_id", "source")


@query(
    f"""WITH {KEPT_CTE}, r AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), k AS (SELECT source, count(*) AS n FROM kept GROUP BY 1)
    SELECT r.source, r.n AS raw, coalesce(k.n, 0) AS kept FROM r LEFT JOIN k USING (source)"""
)
def doc_pipeline_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = documents(spark, sf_dir)
    kept = ingest.clean_documents(raw)
    return ingest.run_stats(raw.select("source"), kept.select("source"), kept.select("source").limit(0)).select("source", "raw", "kept")


@query(
    """SELECT doc_id, i, sha1(substr(text, i * 2300 + 1, 2500)) AS h FROM documents, LATERAL (SELECT unnest(range(0, (length(text) + 2299) // 2300)) AS i) WHERE i * 2300 < length(text)"""
)
def doc_char_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", F.inline(X.char_windows(F.col("text"))))
    return rows.select("doc_id", F.col("i").cast("long").alias("i"), F.sha1(F.col("window").cast("binary")).alias("h"))


_WINDOWS = rf"""words AS (SELECT doc_id, source, list_filter(string_split({_FLAT.format('text')}, ' '), lambda w: w <> '') AS w FROM documents),
windows AS (SELECT doc_id, source, i, list_slice(w, i * 310 + 1, i * 310 + 350) AS x FROM words, LATERAL (SELECT unnest(range(0, CASE WHEN len(w) <= 350 THEN 1 ELSE ceil((len(w) - 350) / 310.0)::INTEGER + 1 END)) AS i))"""


@query(f"WITH {_WINDOWS} SELECT doc_id, i, len(x) AS words, sha1(array_to_string(x, ' ')) AS h FROM windows WHERE len(x) >= 30")
def doc_word_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", F.inline(X.word_windows(F.col("text"))))
    return rows.select("doc_id", F.col("i").cast("long").alias("i"), F.size(F.split("window", " ")).cast("long").alias("words"), F.sha1(F.col("window").cast("binary")).alias("h"))


@query(
    rf"""SELECT doc_id, sha1({_FLAT.format("array_to_string(list_filter(list_transform(string_split(replace(text, '-' || chr(10), ''), chr(10)), lambda l: trim(l)), lambda l: length(l) > 2 AND NOT regexp_matches(l, '^[0-9]{1,4}$')), ' ')")}) AS h FROM documents"""
)
def doc_page_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.sha1(X.clean_page(F.col("text")).cast("binary")).alias("h"))


#: The recursive splitter: texts are cut by the first separator they hold, pieces that are too long again by the finer ones
#: (node); runs of pieces that fit (fit) are folded into chunks with an overlap (merged); places put a text's chunks in order.
_CHUNKS = f"""node AS (
  SELECT doc_id, []::INTEGER[] AS path, text, 1 AS k FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT doc_id, list_append(path, j), piece, sp + 1 FROM (
    SELECT doc_id, path, sp, unnest(range(1, len(pieces) + 1))::INTEGER AS j, unnest(pieces) AS piece FROM (
      SELECT doc_id, path, sp, list_transform(range(1, len(parts) + 1), lambda i: CASE WHEN i > 1 THEN seps[sp] ELSE '' END || parts[i]) AS pieces, text FROM (
        SELECT *, string_split(text, seps[sp]) AS parts FROM (
          SELECT *, coalesce(list_min(list_filter(range(k, 5), lambda s: contains(text, seps[s]))), 4) AS sp FROM (SELECT *, [chr(10) || chr(10), chr(10), '. ', ' '] AS seps FROM node)))))
  WHERE length(piece) >= {ingest.CHUNK_SIZE} AND sp < 4),
piece AS (
  SELECT doc_id, path, sp, j, piece FROM (
    SELECT doc_id, path, sp, unnest(range(1, len(parts) + 1))::INTEGER AS j, unnest(list_transform(range(1, len(parts) + 1), lambda i: CASE WHEN i > 1 THEN seps[sp] ELSE '' END || parts[i])) AS piece FROM (
      SELECT *, string_split(text, seps[sp]) AS parts FROM (
        SELECT *, coalesce(list_min(list_filter(range(k, 5), lambda s: contains(text, seps[s]))), 4) AS sp FROM (SELECT *, [chr(10) || chr(10), chr(10), '. ', ' '] AS seps FROM node)))) WHERE piece <> ''),
fit AS (
  SELECT doc_id, path, g, list_append(path, min(j)) AS place, list({{'c': []::VARCHAR[], 'h': [piece], 't': length(piece)}} ORDER BY j) AS p FROM (
    SELECT *, count(*) FILTER (length(piece) >= {ingest.CHUNK_SIZE}) OVER (PARTITION BY doc_id, path ORDER BY j) AS g FROM piece) WHERE length(piece) < {ingest.CHUNK_SIZE} GROUP BY doc_id, path, g),
merged AS (
  SELECT doc_id, place, list_reduce(p, lambda a, x: CASE WHEN a.t + x.t > {ingest.CHUNK_SIZE} THEN
    list_transform([list_min(list_filter(range(0, len(a.h) + 1), lambda k: k = len(a.h) OR (a.t - coalesce(list_sum(list_transform(a.h[1:k], lambda y: length(y))), 0) <= {ingest.CHUNK_OVERLAP} AND a.t - coalesce(list_sum(list_transform(a.h[1:k], lambda y: length(y))), 0) + x.t <= {ingest.CHUNK_SIZE})))],
      lambda k: {{'c': list_append(a.c, array_to_string(a.h, '')), 'h': list_append(a.h[k + 1:], x.h[1]), 't': (a.t - coalesce(list_sum(list_transform(a.h[1:k], lambda y: length(y))), 0) + x.t)::BIGINT}})[1]
    ELSE {{'c': a.c, 'h': list_append(a.h, x.h[1]), 't': (a.t + x.t)::BIGINT}} END) AS m FROM fit),
told AS (
  SELECT doc_id, place, unnest(range(1, len(c) + 1)) AS n, trim(unnest(c), ' ' || chr(10) || chr(9) || chr(13) || chr(11) || chr(12)) AS chunk FROM (SELECT doc_id, place, list_append(m.c, array_to_string(m.h, '')) AS c FROM merged)
  UNION ALL SELECT doc_id, list_append(path, j), 1, piece FROM piece WHERE length(piece) >= {ingest.CHUNK_SIZE} AND sp = 4),
chunks AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY place, n) - 1)::INTEGER AS i, chunk FROM told WHERE chunk <> '')"""


_WORD = "lower(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g'))"
_TFIDF = f"""t AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 262144 AS f, count(*) AS tf FROM (SELECT doc_id, unnest(string_split({_WORD}, ' ')) AS w FROM documents WHERE doc_id IS NOT NULL) WHERE w <> '' GROUP BY 1, 2),
n AS (SELECT count(DISTINCT doc_id) AS n FROM documents), i AS (SELECT f, ln((any_value(n.n) + 1) / (count(*) + 1)) AS idf FROM t, n GROUP BY 1),
x AS (SELECT doc_id, f, tf * idf AS x FROM t JOIN i USING (f) WHERE tf * idf <> 0), v AS (SELECT doc_id, f, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS w FROM x)"""


@query(f"WITH {_TFIDF} SELECT d.doc_id, count(f) AS n_features, coalesce(round(max(w), 6), 0) AS greatest, coalesce(round(sum(w), 5), 0) AS total FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN v ON v.doc_id = d.doc_id GROUP BY 1")
def tfidf_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    told = encoders.fit_tfidf(docs).encode(docs)
    weight = F.transform("vector", lambda s: s["weight"])
    total = F.aggregate(weight, F.lit(0.0), lambda a, x: a + x)
    return told.select(F.col("id").alias("doc_id"), F.size("vector").cast("long").alias("n_features"), F.coalesce(F.round(F.array_max(weight), 6), F.lit(0.0)).alias("greatest"), F.round(total, 5).alias("total"))


@query(f"WITH {_TFIDF}, s AS (SELECT a.doc_id AS query_id, b.doc_id AS row_id, round(sum(a.w * b.w), 8) AS sim FROM v a JOIN v b ON a.f = b.f AND a.doc_id <> b.doc_id WHERE a.doc_id % 50 = 0 GROUP BY 1, 2) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, row_id)::INTEGER AS rank, row_id, round(sim, 4) AS score FROM s QUALIFY rank <= 5")
def tfidf_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth document's five nearest others by their TF-IDF vectors."""
    docs = table(spark, sf_dir, "documents")
    told = materialise(encoders.fit_tfidf(docs).encode(docs), "tfidf")
    return encoders.nearest_texts(told.filter("id % 50 = 0"), told, 5, exclude_self=True)


@query(
    f"""WITH RECURSIVE {_CHUNKS}, k AS (SELECT md5(concat_ws('_', source, i, substr(chunk, 1, 64))) AS id, source, doc_id, i, length(chunk)::INTEGER AS n FROM chunks JOIN documents USING (doc_id))
    SELECT id, source, doc_id, i, n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY doc_id DESC, i DESC) AS r FROM k) WHERE r = 1"""
)
def doc_chunk_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunked = ingest.chunks(documents(spark, sf_dir).select("ord", "doc_id", "source", "text"))
    return ingest.upsert(chunked, "ord").select("id", "source", "doc_id", "i", F.length("chunk").alias("n"))


@query(
    f"""WITH {_WINDOWS}, c AS (SELECT doc_id, source, i, array_to_string(x, ' ') AS chunk FROM windows WHERE len(x) >= 30),
    k AS (SELECT *, md5(source || '_' || i::VARCHAR || '_' || substr(chunk, 1, 64)) AS id FROM c)
    SELECT id, source, doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY doc_id DESC, i DESC) AS n FROM k) WHERE n = 1"""
)
def window_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("ord", "doc_id", "source", F.inline(X.word_windows(F.col("text"))))
    chunked = rows.select("ord", "doc_id", "source", F.col("i").cast("long").alias("i"), F.col("window").alias("chunk"))
    return ingest.upsert(chunked, "ord").select("id", "source", "doc_id", "i")


@query(
    """WITH a AS (SELECT doc_id, source FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 40), b AS (SELECT doc_id, source FROM documents WHERE lang = 'de' ORDER BY doc_id LIMIT 40)
    SELECT * FROM a UNION ALL SELECT * FROM b"""
)
def doc_limit_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [files.first_rows(spark, f"{sf_dir}/documents.parquet", 40, F.col("lang") == lang) for lang in ("en", "de")]
    return parts[0].unionByName(parts[1]).select("doc_id", "source")


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 3")
def first_n_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    nth = F.row_number().over(W.partitionBy("source").orderBy("doc_id"))
    return documents(spark, sf_dir).select("doc_id", "source").withColumn("n", nth).filter("n <= 3").drop("n")


@query(
    """WITH p AS (SELECT source, doc_id, '- [' || source || '] ' || replace(trim(text), chr(10), ' ') AS line FROM documents),
    r AS (SELECT *, sum(length(line)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS running FROM p)
    SELECT source, doc_id, running::BIGINT AS running, sha1(line) AS h FROM r WHERE running <= 2000"""
)
def rag_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    line = phrases.passage_line(F.lit(None).cast("string"), F.col("source"), F.col("text"))
    rows = context.within_budget(docs.select("source", "doc_id", line.alias("line")), "source", "doc_id", "line")
    return rows.select("source", "doc_id", "running", F.sha1(F.col("line").cast("binary")).alias("h"))


@query("SELECT lang, list_sort(list(DISTINCT CASE WHEN doc_id % 3 = 0 THEN source ELSE 'title ' || (doc_id % 7)::VARCHAR END)) AS sources FROM documents GROUP BY lang")
def answer_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("title "), (F.col("doc_id") % 7).cast("string")))
    return context.answer_sources(documents(spark, sf_dir).withColumn("title", title), "lang", "title", "source")


@query(
    """WITH h AS (SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text)))
    SELECT b.item_id, count(h.doc_id) AS holders FROM benchmark b LEFT JOIN h USING (item_id) GROUP BY 1"""
)
def passage_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring join through an automaton: the entity matcher with the benchmark's passages as names."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.lower("text").alias("entity"))
    found = context.matched_entities(documents(spark, sf_dir), items.select("entity").distinct(), "doc_id", "text", most=1 << 30)
    held = found.join(items, "entity").groupBy("item_id").agg(F.count("*").alias("n"))
    return items.join(held, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("holders"))


@query(
    r"""WITH g AS (SELECT doc_id, source, text, regexp_replace(text, '^[^ ]* ?', '') AS rest, [split_part(text, ' ', 1), split_part(text, ' ', 2), 'zzzz'] AS gold FROM documents),
    c AS (SELECT source, len(list_filter(gold, lambda t: t <> '' AND contains(lower(text), lower(t)))) / 3.0 AS a, len(list_filter(gold, lambda t: t <> '' AND contains(lower(rest), lower(t)))) / 3.0 AS b FROM g)
    SELECT source, round(avg(a), 3) AS mean_a, round(avg(b), 3) AS mean_b, round(avg(a) - avg(b), 3) AS lift, sum((a > b)::INTEGER)::BIGINT AS wins, sum((a = b)::INTEGER)::BIGINT AS ties, count(*) AS n FROM c GROUP BY 1"""
)
def fact_coverage_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arms of answers: whole texts, and texts without their first word; gold are the first two words and a word of none."""
    words = F.split("text", " ")
    gold = F.array(F.coalesce(F.try_element_at(words, F.lit(1)), F.lit("")), F.coalesce(F.try_element_at(words, F.lit(2)), F.lit("")), F.lit("zzzz"))
    arms = documents(spark, sf_dir).select("source", phrases.coverage(F.col("text"), gold).alias("a"), phrases.coverage(F.regexp_replace("text", "^[^ ]* ?", ""), gold).alias("b"))
    return evaluation.lift(arms, "a", "b", ("source",))


# -- catalogue and conversations ---------------------------------------------------------------------------------


@query("SELECT p_partkey, p_name || '. brand: ' || p_brand || '; type: ' || p_type || '; size: ' || p_size::VARCHAR AS text FROM part")
def product_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = phrases.describe_product(F.col("p_name"), {"brand": F.col("p_brand"), "type": F.col("p_type"), "size": F.col("p_size")})
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("text"))


_TURNS = """turns AS (SELECT u.conv_id, u.turn, trim(u.text) AS i, trim(a.text) AS o FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    u = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("input"))
    a = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("completion"))
    return u.join(a, ["conv_id", "turn"])


@query(f"WITH {_TURNS} SELECT conv_id, turn, sha1('Styling example. Profile: ' || i || '. Occasion: . Advice: ' || o) AS h FROM turns WHERE o <> ''")
def instruct_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = phrases.instruction(F.col("input"), F.lit(None).cast("string"), F.col("completion"))
    rows = turns(spark, sf_dir).select("conv_id", "turn", text.alias("t")).filter("t IS NOT NULL")
    return rows.select("conv_id", "turn", F.sha1(F.col("t").cast("binary")).alias("h"))


@query(
    f"""WITH {_TURNS}, e AS (SELECT conv_id * 1000 + turn AS ord, i AS u, o FROM turns WHERE i <> '' AND o <> ''),
    d AS (SELECT u, min(ord) AS ord FROM e GROUP BY u), n AS (SELECT greatest(1, floor(count(*) * 0.1)::BIGINT) AS n FROM d),
    v AS (SELECT *, row_number() OVER (ORDER BY md5(u || ':42'), u) AS r FROM d)
    SELECT ord, CASE WHEN r <= n THEN 'valid' ELSE 'train' END AS part FROM v, n"""
)
def chat_examples_dedup_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), "input", F.lit(None).cast("string").alias("context"), "completion")
    pairs = rows.select("ord", F.trim("input").alias("user"), F.trim("completion").alias("assistant")).filter("user <> '' AND assistant <> ''")
    once = supervision.first_per_user_turn(pairs, "ord")
    return supervision.train_valid(once, F.col("user")).select("ord", "part")


_INTENT = "coalesce(" + ", ".join(f"CASE WHEN s{i} > 0 AND s{i} = greatest({', '.join(f's{j}' for j in range(len(context.INTENTS)))}) THEN '{name}' END" for i, name in enumerate(context.INTENTS)) + ", 'unknown')"
_PROBE = {"bootstrap": ("thand", "ander"), "style": ("the ",), "analyze": ("tion", "ment"), "design": ("ing ",), "pattern": ("lich",), "full_cycle": ("ción",)}
_SCORES = ", ".join("(" + " + ".join(f"contains(lower(text), '{w}')::INTEGER" for w in words) + f") AS s{i}" for i, words in enumerate(_PROBE.values()))


@query(f"SELECT conv_id, turn, {_INTENT} AS intent FROM (SELECT conv_id, turn, {_SCORES} FROM conversations)")
def intent_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyword table is a parameter: invented prose has none of the real one's words."""
    return context.classify(table(spark, sf_dir, "conversations"), "text", _PROBE).select("conv_id", "turn", "intent")


@query(
    """WITH c AS (SELECT conv_id * 100 + turn AS row, role AS designer, 'Fall ' || turn::VARCHAR AS sn, trim(text) AS caption FROM conversations)
    SELECT row, replace(replace(CASE row % 3 WHEN 0 THEN 'Describe a runway look from {d}''s {s} collection.' WHEN 1 THEN 'What might a {d} look from {s} feature?' ELSE 'Give a short styling description of a {d} {s} runway look.' END, '{d}', designer), '{s}', sn) AS prompt, length(caption) AS n
    FROM c WHERE caption <> ''"""
)
def caption_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("row"), F.col("role").alias("designer"), F.concat(F.lit("Fall "), F.col("turn").cast("string")).alias("show"), F.col("text").alias("caption"))
    return supervision.caption_tasks(c).select("row", F.col("user").alias("prompt"), F.length("assistant").cast("long").alias("n"))


@query(
    """SELECT doc_id, lang || CASE WHEN doc_id % 2 = 0 THEN ' ' || source ELSE '' END AS brand, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source || ' ' END || CASE WHEN doc_id % 2 = 0 THEN lang || ' ' ELSE '' END || 'styling advice outfit' AS look,
    CASE doc_id % 3 WHEN 0 THEN 'Unknown — ' || source || ', look ' || doc_id::VARCHAR WHEN 1 THEN lang || ' (source: ' || source || ')' ELSE 'unlabeled look (source: unknown)' END AS hit, sha1(to_base64(encode(text))) AS image FROM documents"""
)
def retrieval_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval queries, descriptions of hits and encoded contents of every document."""
    nothing = F.lit(None).cast("string")
    told = F.create_map(F.lit("aesthetic"), F.col("lang"), F.lit("category"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(""))
    third = lambda n, c: F.when(F.col("doc_id") % 3 == n, c)
    garments = F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("source"))
    hit = prompts.told_hit(nothing, third(0, F.col("source")), third(0, F.col("doc_id")), third(1, F.col("lang")), third(1, F.col("source")))
    occasion = F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("")
    return documents(spark, sf_dir).select("doc_id", prompts.brand_query(told).alias("brand"), prompts.look_query(garments, occasion).alias("look"), hit.alias("hit"), F.sha1(prompts.encoded_image(F.col("text").cast("binary")).cast("binary")).alias("image"))


# -- knowledge graph ---------------------------------------------------------------------------------------------

_KEY0 = r"trim(regexp_replace(regexp_replace(replace(replace(lower({0}), '_', ' '), '-', ' '), '[^a-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g'))"
_KEY = f"regexp_replace({_KEY0}, '( ({'|'.join(naming.SUFFIXES)}))+$', '')"
_OK = r"(length({0}) >= 3 AND len(string_split({0}, ' ')) <= 6 AND NOT (len(string_split({0}, ' ')) > 2 AND len(list_filter(string_split({0}, ' '), lambda w: regexp_matches(w, '^(1[89]\d0s?|20\d0s?|\d{{4}})$'))) > 0) AND NOT contains(' ' || {0} || ' ', ' from ') AND NOT contains(' ' || {0} || ' ', ' and his ') AND NOT contains(' ' || {0} || ' ', ' including ') AND NOT contains(' ' || {0} || ' ', ' where '))"
KG = f"""raw AS (
  SELECT 1000000000000 + s_suppkey AS ord, s_name AS subject, 'based_in' AS relation, n_name AS object FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 2000000000000 + n_nationkey, n_name, 'part_of', r_name FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 3000000000000 + c_custkey, c_name, 'based_in', n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 4000000000000 + p_partkey, p_name, 'part_of', p_brand FROM part
  UNION ALL SELECT 5000000000000 + p_partkey, p_name, 'has_property', p_type FROM part
  UNION ALL SELECT 6000000000000 + min(l_partkey) * 100000 + min(l_suppkey), s_name, 'uses_material', p_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY s_name, p_name),
keyed AS (SELECT *, {_KEY.format('subject')} AS subject_key, {_KEY.format('object')} AS object_key, {_KEY0.format('subject')} AS sn, {_KEY0.format('object')} AS obn FROM raw),
triples AS (SELECT ord, subject, relation, object, subject_key, object_key FROM (
  SELECT *, row_number() OVER (PARTITION BY subject_key, relation, object_key ORDER BY ord) AS n FROM keyed
  WHERE subject_key <> object_key AND {_OK.format('sn')} AND {_OK.format('obn')}) WHERE n = 1)"""


def raw_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star schema told as facts, with relation names as extraction would give them."""
    t = {n: table(spark, sf_dir, n) for n in STAR}
    offset = lambda k, c: (F.lit(k * 10**12) + c).cast("long").alias("ord")

    def told(df: DataFrame, k: int, key, subject: str, relation: str, obj: str, types: tuple[str, str]) -> DataFrame:
        return df.select(offset(k, key), F.col(subject).alias("subject"), F.lit(relation).alias("relation"), F.col(obj).alias("object"), F.lit(types[0]).alias("subject_type"), F.lit(types[1]).alias("object_type"), F.lit("star").alias("source"))

    # names of parts are few, pairs of keys nearly as many as lines: a supplier's lines meet in one task and leave it as one row a name
    lines = t["lineitem"].select("l_suppkey", "l_partkey").join(t["part"].select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    uses = lines.select("l_suppkey", "l_partkey", "p_name").repartition(shuffle_partitions(lines), "l_suppkey", "p_name").groupBy("l_suppkey", "p_name").agg(F.min("l_partkey").alias("l_partkey"))
    uses = uses.join(t["supplier"].select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    uses = uses.groupBy("s_name", "p_name").agg((F.min("l_partkey") * 100_000 + F.min("l_suppkey")).alias("first"))
    parts = [  # parts share names, so most of what they tell is repeated
        told(t["supplier"].join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey")), 1, F.col("s_suppkey"), "s_name", "Located in", "n_name", ("brand", "city")),
        told(t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")), 2, F.col("n_nationkey"), "n_name", "belongs-to", "r_name", ("city", "city")),
        told(t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")), 3, F.col("c_custkey"), "c_name", "from", "n_name", ("brand", "city")),
        T.said_once(told(t["part"], 4, F.col("p_partkey"), "p_name", "part_of", "p_brand", ("garment", "brand"))),
        T.said_once(told(t["part"], 5, F.col("p_partkey"), "p_name", "property", "p_type", ("garment", "property"))),
        told(uses, 6, F.col("first"), "s_name", "made of", "p_name", ("brand", "material")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


STAR = ("supplier", "nation", "region", "customer", "part", "lineitem")


def star_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The triple store: built once from the star schema, laid out by subject, and read by every graph query."""
    sources = tuple(f"{sf_dir}/{n}.parquet" for n in STAR)
    return built_once(spark, "triples", sources, lambda: T.canonical_triples(materialise(raw_triples(spark, sf_dir), "raw-triples"), unaccent=False), "subject_key")  # ASCII names


@query(f"WITH {KG} SELECT ord, subject, relation, object, subject_key, object_key FROM triples")
def kg_build_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The build itself, not what is stored."""
    return T.canonical_triples(raw_triples(spark, sf_dir), unaccent=False).select("ord", "subject", "relation", "object", "subject_key", "object_key")


@query(
    f"""WITH {KG}, e AS (SELECT subject_key AS k FROM triples UNION SELECT object_key FROM triples)
    SELECT 'triples' AS item, count(*) AS n FROM triples UNION ALL SELECT 'entities', count(*) FROM e UNION ALL SELECT 'relation:' || relation, count(*) FROM triples GROUP BY relation"""
)
def kg_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.stats(star_triples(spark, sf_dir))


@query(f"WITH {KG} SELECT min(subject) AS subject, subject_key, count(*) AS n_facts FROM triples GROUP BY subject_key ORDER BY n_facts DESC, subject_key LIMIT 20")
def kg_top_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.top_subjects(star_triples(spark, sf_dir), 20)


@query(f"WITH {KG} SELECT subject_key AS entity FROM triples UNION SELECT object_key FROM triples")
def kg_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.entities(star_triples(spark, sf_dir))


@query(f"WITH {KG} SELECT ord, subject, relation, object FROM triples WHERE subject_key = 'nation 3' OR object_key = 'nation 3' ORDER BY ord LIMIT 50")
def kg_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.neighbors(star_triples(spark, sf_dir), "NATION_3").select("ord", "subject", "relation", "object")


@query(f"WITH {KG} SELECT relation, object FROM triples WHERE subject_key = 'supplier 000000001'")
def kg_outgoing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.outgoing(star_triples(spark, sf_dir), "Supplier#000000001").select("relation", "object")


@query(f"WITH {KG} SELECT ord, subject || ' ' || replace(relation, '_', ' ') || ' ' || object AS fact FROM triples WHERE subject_key = 'asia' OR object_key = 'asia'")
def kg_edges_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.edges_of(star_triples(spark, sf_dir), "asia").select("ord", phrases.fact_text(F.col("subject"), F.col("relation"), F.col("object")).alias("fact"))


@query(f"WITH {KG} SELECT subject || ' ' || replace(relation, '_', ' ') || ' ' || object AS fact FROM triples WHERE subject_key = 'supplier 000000002' OR object_key = 'supplier 000000002' ORDER BY ord LIMIT 25")
def kg_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.facts(star_triples(spark, sf_dir), "supplier_000000002")


@query(f"WITH {KG} SELECT DISTINCT subject FROM triples WHERE relation = 'based_in' AND object_key = 'nation 5'")
def kg_subjects_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.subjects_with(star_triples(spark, sf_dir), "located_in", "NATION-5")


@query(f"WITH {KG} SELECT object FROM triples WHERE subject_key = 'supplier 000000003' AND relation = 'uses_material'")
def kg_objects_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.objects_of(star_triples(spark, sf_dir), "Supplier 000000003", "uses_material")


@query(
    f"""WITH {KG}, f AS (SELECT * FROM triples WHERE subject_key = 'nation 2' OR object_key = 'nation 2' ORDER BY ord LIMIT 40),
    v AS (SELECT k AS via FROM (SELECT subject_key AS k FROM f UNION SELECT object_key FROM f) WHERE k <> 'nation 2' ORDER BY k LIMIT 40),
    a AS (SELECT DISTINCT via, t.ord, t.subject, t.relation, t.object FROM v JOIN triples t ON t.subject_key = via OR t.object_key = via),
    s AS (SELECT *, row_number() OVER (PARTITION BY via ORDER BY ord, subject, relation, object) AS n FROM a)
    SELECT 1 AS hop, 'nation 2' AS via, ord, subject, relation, object FROM f UNION ALL SELECT 2, via, ord, subject, relation, object FROM s WHERE n <= 5"""
)
def kg_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.two_hop(star_triples(spark, sf_dir), "nation 2")


@query(
    f"""WITH RECURSIVE {KG}, e AS (SELECT subject_key AS a, object_key AS b FROM triples UNION SELECT object_key, subject_key FROM triples),
    w AS (SELECT 'supplier 000000001' AS node, 0 AS hops UNION SELECT e.b, w.hops + 1 FROM w JOIN e ON e.a = w.node WHERE w.hops < 2)
    SELECT node, min(hops)::INTEGER AS hops FROM w GROUP BY node"""
)
def kg_hop_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.hop_distances(star_triples(spark, sf_dir), "Supplier#000000001", 2)


@query(
    f"""WITH {KG}, s AS (SELECT ord, subject_key AS a, object_key AS b, relation, subject AS x, object AS y FROM triples UNION ALL SELECT ord, object_key, subject_key, relation, object, subject FROM triples),
    one AS (SELECT * FROM s WHERE a = 'supplier 000000001'), hit1 AS (SELECT x || ' —' || relation || '→ ' || y AS path, 1 AS hops FROM one WHERE b = 'nation 0'),
    tree AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY ord) AS n FROM one WHERE b <> 'supplier 000000001') WHERE n = 1),
    hit2 AS (SELECT t.x || ' —' || t.relation || '→ ' || t.y || ' —' || s.relation || '→ ' || s.y AS path, 2 AS hops FROM tree t JOIN s ON s.a = t.b WHERE s.b = 'nation 0'),
    two AS (SELECT s.b, t.x, t.relation AS r1, t.y AS y1, s.relation AS r2, s.y AS y2, row_number() OVER (PARTITION BY s.b ORDER BY t.ord, s.ord) AS n FROM tree t JOIN s ON s.a = t.b
      WHERE s.b <> 'supplier 000000001' AND s.b NOT IN (SELECT b FROM tree)),
    hit3 AS (SELECT t.x || ' —' || r1 || '→ ' || y1 || ' —' || r2 || '→ ' || y2 || ' —' || s.relation || '→ ' || s.y AS path, 3 AS hops FROM two t JOIN s ON s.a = t.b WHERE t.n = 1 AND s.b = 'nation 0')
    SELECT * FROM hit1 UNION ALL SELECT * FROM hit2 WHERE NOT EXISTS (SELECT 1 FROM hit1) UNION ALL SELECT * FROM hit3 WHERE NOT EXISTS (SELECT 1 FROM hit1) AND NOT EXISTS (SELECT 1 FROM hit2)"""
)
def kg_shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.shortest_paths(star_triples(spark, sf_dir), "Supplier#000000001", "NATION_0", 3)
    return found.select(phrases.path_text(F.col("start"), F.col("path")).alias("path"), "hops")


@query(f"WITH {KG} SELECT ord, subject, relation, object FROM triples WHERE ord >= 4000000000000")
def kg_upsert_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_rows = star_triples(spark, sf_dir)
    return T.insert_new(all_rows.filter(F.col("ord") < 4 * 10**12), all_rows).select("ord", "subject", "relation", "object")


@query(
    f"""WITH {KG}, c AS (SELECT DISTINCT a.subject, a.subject_key, b.relation, b.object, b.object_key, min(b.ord) OVER (PARTITION BY a.subject_key, b.relation, b.object_key) AS ord
      FROM triples a JOIN triples b ON a.object_key = b.subject_key WHERE a.relation = 'based_in'),
    f AS (SELECT c.* FROM c LEFT JOIN triples t ON t.subject_key = c.subject_key AND t.relation = c.relation AND t.object_key = c.object_key WHERE t.ord IS NULL AND c.subject_key <> c.object_key)
    SELECT subject_key, relation, object_key, row_number() OVER (PARTITION BY subject_key ORDER BY ord)::INTEGER AS rank FROM f QUALIFY rank <= 10"""
)
def kg_link_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = star_triples(spark, sf_dir)
    a = t.filter("relation = 'based_in'").select("subject", "subject_key", F.col("object_key").alias("via"))
    b = t.select(F.col("subject_key").alias("via"), "ord", "relation", "object", "object_key", "subject_type", "object_type", "source")
    candidates = a.join(b, "via").drop("via").filter("subject_key <> object_key").select(*T.COLUMNS)
    return T.new_candidates(candidates, t).select("subject_key", "relation", "object_key", "rank")


@query(
    f"""WITH {KG}, top AS (SELECT min(subject) AS subject, subject_key, count(*) AS n_facts FROM triples GROUP BY subject_key ORDER BY n_facts DESC, subject_key LIMIT 400),
    r AS (SELECT *, CASE relation WHEN 'uses_material' THEN 3 WHEN 'based_in' THEN 6 END AS place, row_number() OVER (PARTITION BY subject_key, relation ORDER BY ord) AS nth FROM triples),
    g AS (SELECT subject_key, place, string_agg(object, ', ' ORDER BY nth) AS part FROM r WHERE nth <= 3 AND place IS NOT NULL GROUP BY 1, 2),
    p AS (SELECT subject_key, string_agg(part, '; ' ORDER BY place) AS text FROM g GROUP BY 1)
    SELECT subject, n_facts, subject || ' — ' || text AS descriptor FROM top JOIN p USING (subject_key) WHERE n_facts >= 3"""
)
def kg_descriptor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.descriptors(star_triples(spark, sf_dir))


#: Parts told as fabrics: their names with what size and price say of them.
_FABRIC = """f AS (SELECT p_partkey, p_name AS fabric, CASE WHEN p_size < 15 THEN 'light' WHEN p_size < 35 THEN 'medium' ELSE 'heavy' END AS weight, CASE p_size % 3 WHEN 0 THEN 'crisp' WHEN 1 THEN 'fluid' ELSE '' END AS drape,
CASE WHEN p_size % 2 = 0 THEN 'cool' ELSE 'warm' END AS warmth, CASE WHEN p_size > 40 THEN ['winter'] ELSE ['summer', 'spring'] END AS season, [lower(p_type)] AS texture, ['size ' || (p_size // 10)::VARCHAR, 'woven'] AS properties FROM part),
t AS (SELECT fabric AS subject, 'has_property' AS relation, unnest(list_concat(properties, list_filter([weight || ' weight', CASE WHEN drape <> '' THEN drape || ' drape' ELSE '' END, warmth], lambda x: x <> ''))) AS object FROM f
UNION SELECT fabric, 'has_texture', unnest(texture) FROM f UNION SELECT fabric, 'suits_season', unnest(season) FROM f)"""


def fabrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    weight = F.when(size < 15, "light").when(size < 35, "medium").otherwise("heavy").alias("weight")
    drape = F.when(size % 3 == 0, "crisp").when(size % 3 == 1, "fluid").otherwise("").alias("drape")
    season = F.when(size > 40, F.array(F.lit("winter"))).otherwise(F.array(F.lit("summer"), F.lit("spring"))).alias("season")
    properties = F.array(F.concat(F.lit("size "), F.expr("CAST(p_size DIV 10 AS STRING)")), F.lit("woven")).alias("properties")
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("fabric"), weight, drape, F.when(size % 2 == 0, "cool").otherwise("warm").alias("warmth"), season, F.array(F.lower("p_type")).alias("texture"), properties)


@query(f"WITH {_FABRIC} SELECT DISTINCT subject, relation, object FROM t")
def fabric_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.canonical_triples(T.fabric_triples(fabrics(spark, sf_dir)), unaccent=False).select("subject", "relation", "object")


@query(f"WITH {_FABRIC}, n AS (SELECT count(*) AS n FROM (SELECT DISTINCT subject, relation, object FROM t)) SELECT 1 AS run, n AS added FROM n UNION ALL SELECT 2, 0")
def fabric_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ontology goes into a stored graph twice: the second time adds nothing."""
    path = shared_path(spark, "graph")
    added = [knowledge.add_fabrics(fabrics(spark, sf_dir), path, unaccent=False) for _ in (1, 2)]
    return spark.createDataFrame(list(enumerate(added, 1)), "run int, added long")


_RAW_RELATIONS = {"located_in": "based_in", "Inspired By": "influenced_by", "designed-by": "creative_director", "totally_unknown": "", "known for": "known_for", " MADE OF ": "uses_material", "part of": "part_of"}
_RAW_LIST = "[" + ", ".join(f"'{r}'" for r in _RAW_RELATIONS) + "]"


@query(f"SELECT event_type, raw, [{', '.join(repr(r) for r in _RAW_RELATIONS.values())}][i + 1] AS relation, count(*) AS n FROM (SELECT event_type, user_id % {len(_RAW_RELATIONS)} AS i, upper({_RAW_LIST}[(user_id % {len(_RAW_RELATIONS)}) + 1]) AS raw FROM events WHERE user_id IS NOT NULL) GROUP BY ALL")
def relation_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event states a relation in one of several spellings, by its user."""
    said = F.element_at(F.array(*map(F.lit, _RAW_RELATIONS)), (F.col("user_id") % len(_RAW_RELATIONS)).cast("int") + 1)
    rows = table(spark, sf_dir, "events").filter("user_id IS NOT NULL").select("event_type", F.upper(said).alias("raw"))
    return rows.groupBy("event_type", "raw", naming.canonical_relation(F.col("raw")).alias("relation")).agg(F.count("*").alias("n"))


@query(
    """SELECT c_custkey, n || CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN ' dior' WHEN 3 THEN ' fall 1960 collection' WHEN 4 THEN ' including nation' ELSE ' celine' END AS entity, c_custkey % 6 NOT IN (3, 4) AS plausible
    FROM (SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) AS n FROM customer)"""
)
def entity_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's name as it might be written: with a company's suffix, accents, blanks, a date or a phrase."""
    k, n = F.col("c_custkey") % 6, F.col("c_name")
    raw = F.when(k == 0, n).when(k == 1, F.concat(F.lit("  "), n, F.lit("   House SE"))).when(k == 2, F.concat(n, F.lit(" Dior Parfums"))).when(k == 3, F.concat(n, F.lit(" fall 1960 collection"))).when(k == 4, F.concat(n, F.lit(" including Nation"))).otherwise(F.concat(n, F.lit(" Céline")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw"))
    return rows.select("c_custkey", naming.canonical_entity(F.col("raw")).alias("entity"), naming.is_plausible(naming.normalize_entity(F.col("raw"))).alias("plausible"))


@query("SELECT doc_id, ['A', 'tie', 'tie', 'B', 'A', 'tie', 'B'][(doc_id % 7) + 1] AS verdict, CASE (doc_id % 7) WHEN 0 THEN 'A' WHEN 4 THEN 'A' WHEN 3 THEN 'B' WHEN 6 THEN 'B' ELSE 'tie' END = 'A' AS a_won, CASE WHEN doc_id % 7 IN (1, 2, 5) THEN 'tie' WHEN (doc_id % 7 IN (0, 4)) = (doc_id % 2 = 0) THEN 'kg' ELSE 'rag' END AS arm FROM documents")
def verdict_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges' replies made of every document: reasons in its own words, and the verdict in one of several forms."""
    said = F.lower(F.substring(F.coalesce("text", F.lit("")), 1, 400))
    forms = [F.lit("A"), F.lit(" TIE, both are fine"), F.lit(""), F.concat(said, F.lit("\nAnswer A is vague; B wins.\nVERDICT: B")), F.concat(said, F.lit("\nVerdict: A")), F.concat(said, F.lit("\nVERDICT: TIE")), F.lit("b, for its facts")]
    raw = F.coalesce(*(F.when(F.col("doc_id") % 7 == i, f) for i, f in enumerate(forms)))
    v = phrases.verdict(F.col("raw"))
    rows = table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"))
    return rows.select("doc_id", v.alias("verdict"), (v == "A").alias("a_won"), phrases.unblinded(v, F.col("doc_id") % 2 == 0).alias("arm"))


@query("SELECT s_name AS subject, 'based_in' AS relation, n_name AS object, 'reply ' || (s_suppkey % 3)::VARCHAR AS source FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 5 <> 4 UNION ALL SELECT s_name, 'known_for', 'patience', 'reply ' || (s_suppkey % 3)::VARCHAR FROM supplier WHERE s_suppkey % 5 IN (0, 1)")
def parse_triples_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's reply about every supplier: a list amid words, unknown relations, items of other kinds, broken lists and none."""
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    first = '{"subject":"<s>","subject_type":"Brand","relation":"located in","object":"<n>","object_type":"city"}'
    forms = (
        "Here: [" + first + ', {"subject":"<s>","relation":"loves","object":"<n>"}, {"subject":"<s>","relation":"famous_for","object":"patience"}] done',
        "[" + first + ", " + first + ', {"subject":" <s> ","relation":"known-for","object":"patience "}, null]',
        "[" + first + ', {"subject":"<s>","relation":"based_in","object":"<s>"}]',
        "```json\n[" + first + "]\n```",
        'no list of <s>: [{"subject":',
    )
    names = {"<s>": F.col("s_name"), "<n>": F.col("n_name")}
    raw = F.coalesce(*(F.when(F.col("s_suppkey") % 5 == k, F.concat(*(names.get(part, F.lit(part)) for part in re.split("(<s>|<n>)", form)))) for k, form in enumerate(forms)))
    replies = rows.select(F.col("s_suppkey").cast("long").alias("ord"), raw.alias("raw"), F.concat(F.lit("reply "), (F.col("s_suppkey") % 3).cast("string")).alias("source"))
    return T.canonical_triples(perception.parse_triples(replies, "raw", "source"), unaccent=False).select("subject", "relation", "object", "source")


@query(
    """WITH l AS (SELECT p_partkey AS row, p_name AS designer, 'Fall ' || (2000 + p_size % 4)::VARCHAR AS season, lower(p_type) AS s, 'grade ' || (p_size % 5)::VARCHAR AS m, p_partkey % 4 AS form FROM part),
    t AS (SELECT designer, 'has_silhouette' AS relation, s AS object FROM l WHERE form < 3 UNION SELECT designer, 'uses_material', m FROM l WHERE form < 2 UNION SELECT designer, 'uses_material', 'wool felt' FROM l WHERE form = 0 UNION SELECT designer, 'known_for', 'quiet luxury' FROM l WHERE form = 1 UNION SELECT designer, 'from_era', season FROM l WHERE season <> 'Fall 2000')
    SELECT DISTINCT designer AS subject, relation, object FROM t"""
)
def parse_look_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's reply about every part as a look: lists, single strings, nulls, and what is no JSON at all."""
    silhouette, material, form = F.lower("p_type"), F.concat(F.lit("grade "), (F.col("p_size") % 5).cast("string")), F.col("p_partkey") % 4
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    raw = (
        F.when(form == 0, F.concat(F.lit('ok {"caption": " A coat ", "silhouettes": ['), quoted(silhouette), F.lit('], "materials": ["wool felt", "", '), quoted(material), F.lit('], "garments": null} end')))
        .when(form == 1, F.concat(F.lit('{"silhouettes": '), quoted(silhouette), F.lit(', "materials": '), quoted(material), F.lit(', "aesthetics": ["quiet luxury"]}')))
        .when(form == 2, F.concat(F.lit('{"silhouettes": ['), quoted(silhouette), F.lit("]}")))
        .otherwise(F.concat(F.lit("garbage about "), "p_name"))
    )
    season = F.when(F.col("p_size") % 4 > 0, F.concat(F.lit("Fall "), (2000 + F.col("p_size") % 4).cast("string"))).otherwise("")
    looks = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("designer"), season.alias("season"), perception.parse_look(raw).alias("look"))
    return T.canonical_triples(perception.look_triples(looks), unaccent=False).select("subject", "relation", "object")


@query(
    f"""WITH {KG}, c AS (SELECT doc_id, e.entity, row_number() OVER (PARTITION BY doc_id ORDER BY length(e.entity) DESC, e.entity) AS place
      FROM (SELECT conv_id * 100 + turn AS doc_id, lower(text || ' ' || CASE WHEN turn % 2 = 0 THEN 'red widget for nation_' || (conv_id % 25)::VARCHAR ELSE 'supplier asia' END) AS q FROM conversations) d
      JOIN (SELECT subject_key AS entity FROM triples UNION SELECT object_key FROM triples) e ON contains(d.q, e.entity)) SELECT doc_id AS id, entity, place::INTEGER AS place FROM c WHERE place <= 4"""
)
def context_entity_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    said = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("red widget for nation_"), (F.col("conv_id") % 25).cast("string"))).otherwise("supplier asia")
    queries = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.concat_ws(" ", "text", said).alias("q"))
    return context.matched_entities(queries, T.entities(star_triples(spark, sf_dir)), "id", "q").select("id", "entity", "place")


_MATCHED = """m AS (SELECT doc_id AS id, e.entity, row_number() OVER (PARTITION BY doc_id ORDER BY length(e.entity) DESC, e.entity) AS place
      FROM (SELECT conv_id * 100 + turn AS doc_id, lower(text || ' ' || CASE WHEN turn % 2 = 0 THEN 'red widget for nation_' || (conv_id % 25)::VARCHAR ELSE 'supplier asia' END) AS q FROM conversations) d
      JOIN (SELECT subject_key AS entity FROM triples UNION SELECT object_key FROM triples) e ON contains(d.q, e.entity) QUALIFY place <= 4)"""


@query(
    f"""WITH {KG}, {_MATCHED}, s AS (SELECT subject_key AS key, * FROM triples UNION ALL SELECT object_key, * FROM triples),
    n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord) AS nth FROM s) WHERE nth <= 25),
    t AS (SELECT id, min(place * 1000 + nth) AS k, subject || ' ' || replace(relation, '_', ' ') || ' ' || object AS fact FROM m JOIN n ON entity = key GROUP BY 1, 3)
    SELECT id, row_number() OVER (PARTITION BY id ORDER BY k)::INTEGER AS place, fact FROM t QUALIFY place <= 20"""
)
def context_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of the entities that every turn of every conversation names."""
    return context.entity_facts(context_entity_match(spark, sf_dir), star_triples(spark, sf_dir))


_MATERIALS = f"""{KG}, c AS (SELECT DISTINCT subject_key AS owner, object_key AS concept FROM triples WHERE relation = 'uses_material')"""


@query(f"WITH {_MATERIALS} SELECT owner, list_sort(list(concept)) AS concepts FROM c GROUP BY owner")
def concept_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supervision.concept_sets(star_triples(spark, sf_dir))


@query(f"WITH {_MATERIALS} SELECT concept, count(*) AS n_owners FROM c GROUP BY 1 HAVING count(*) >= 2")
def concept_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supervision.concept_vocabulary(supervision.concepts(star_triples(spark, sf_dir)))


_JACCARD = f"""{_MATERIALS}, n AS (SELECT owner, count(*) AS n FROM c GROUP BY 1),
j AS (SELECT a.owner AS a, b.owner AS b, count(*) / (any_value(x.n) + any_value(y.n) - count(*)) AS jaccard FROM c a JOIN c b ON a.concept = b.concept AND a.owner < b.owner JOIN n x ON x.owner = a.owner JOIN n y ON y.owner = b.owner GROUP BY 1, 2)"""


@query(f"WITH {_JACCARD} SELECT a, b, round(jaccard, 6) AS jaccard FROM j")
def jaccard_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps.jaccard_pairs(supervision.concepts(star_triples(spark, sf_dir)), digits=6)


@query(f"WITH {_JACCARD} SELECT a, b, round(jaccard, 6) AS jaccard FROM j WHERE jaccard >= 0.8")
def jaccard_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps.similar_owners(supervision.concepts(star_triples(spark, sf_dir)), 0.8, digits=6)


@query(
    f"""WITH {_MATERIALS}, l AS (SELECT c_custkey AS row, CASE WHEN c_custkey % 9 = 0 THEN c_name ELSE 'Supplier#' || lpad((c_custkey % 60)::VARCHAR, 9, '0') END AS designer, c_mktsegment AS g FROM customer), s AS (SELECT owner, list_sort(list(concept)) AS concepts FROM c GROUP BY 1)
    SELECT row, designer, g AS "group", coalesce(concepts, []) AS concepts FROM l LEFT JOIN s ON owner = {_KEY.format('designer')}"""
)
def look_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as a look by a supplier (or by a house that the graph does not know), with that house's concepts."""
    house = F.when(F.col("c_custkey") % 9 == 0, F.col("c_name")).otherwise(F.concat(F.lit("Supplier#"), F.lpad((F.col("c_custkey") % 60).cast("string"), 9, "0")))
    looks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row"), house.alias("designer"), F.col("c_mktsegment").alias("group"))
    return supervision.look_records(looks, supervision.concepts(star_triples(spark, sf_dir)), unaccent=False)


@query(
    f"""WITH {_JACCARD}, l AS (SELECT s_suppkey AS row, {_KEY.format('s_name')} AS designer, s_nationkey::VARCHAR AS show FROM supplier),
    k AS (SELECT concept, count(*) AS k FROM c WHERE owner IN (SELECT designer FROM l) GROUP BY 1)
    SELECT (SELECT count(*) FROM l) AS n_images, (SELECT count(DISTINCT designer) FROM l) AS n_designers, (SELECT count(*) FROM k) AS unique_concepts, (SELECT sum((k > 1)::INTEGER) FROM k)::BIGINT AS shared_concepts,
    (SELECT round(sum((k > 1)::INTEGER) / count(*), 3) FROM k) AS shared_fraction, (SELECT round(sum(jaccard) / (count(DISTINCT designer) * (count(DISTINCT designer) - 1) / 2), 3) FROM (SELECT sum(jaccard) AS jaccard FROM j), l) * 0 + round((SELECT sum(jaccard) FROM j) / (SELECT count(DISTINCT designer) * (count(DISTINCT designer) - 1) / 2 FROM l), 3) AS mean_jaccard,
    (SELECT count(DISTINCT designer || '|' || l."show") FROM l) AS n_collections, (SELECT count(*) FROM l WHERE designer NOT IN (SELECT owner FROM c))::BIGINT AS images_without_concepts"""
)
def signal_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    looks = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row"), naming.canonical_entity(F.col("s_name"), unaccent=False).alias("designer"), F.col("s_nationkey").cast("string").alias("show"))
    report = supervision.signal_report(looks, supervision.concepts(star_triples(spark, sf_dir)))
    return report.select("n_images", "n_designers", "unique_concepts", "shared_concepts", "shared_fraction", "mean_jaccard", "n_collections", "images_without_concepts")


@query(
    f"""WITH {KG}, o AS (SELECT subject_key, min_by(subject, ord) OVER (PARTITION BY subject_key) AS s0, relation, ord, object FROM triples WHERE relation IN ('based_in', 'uses_material')),
    d AS (SELECT subject_key, relation, trim(replace(object, '_', ' ')) AS o, min(ord) AS ord FROM triples WHERE relation IN ('based_in', 'uses_material') GROUP BY 1, 2, 3),
    f AS (SELECT *, row_number() OVER (PARTITION BY subject_key, relation ORDER BY ord) AS nth FROM d),
    g AS (SELECT subject_key, relation, list(o ORDER BY nth) AS os FROM f WHERE nth <= CASE relation WHEN 'based_in' THEN 2 ELSE 5 END GROUP BY 1, 2),
    s AS (SELECT subject_key, min_by(subject, ord) AS s FROM triples WHERE relation IN ('based_in', 'uses_material') GROUP BY 1),
    p AS (SELECT s.s, relation, CASE len(os) WHEN 1 THEN os[1] WHEN 2 THEN os[1] || ' and ' || os[2] ELSE array_to_string(os[1:-2], ', ') || ', and ' || os[-1] END AS phrase FROM g JOIN s USING (subject_key))
    SELECT s AS subject, relation, CASE relation WHEN 'based_in' THEN 'Where is ' || s || ' based?' ELSE 'What materials is ' || s || ' known for using?' END AS question,
    CASE relation WHEN 'based_in' THEN s || ' is based in ' || phrase || '.' ELSE s || ' frequently works with ' || phrase || '.' END AS answer FROM p"""
)
def qa_from_kg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supervision.question_answers(star_triples(spark, sf_dir))


_RULES = {
    "ción": '[{"subject":"Dior","relation":"located in","object":"Paris"},{"subject":"Dior","relation":"famous_for","object":"the new look"}]',
    "lich": '[{"subject":"Jil Sander","relation":"based_in","object":"Hamburg"},{"subject":"Jil Sander","relation":"adores","object":"Hamburg"}]',
    "tion": 'Found: [{"subject":"Burberry","relation":"uses","object":"gabardine"},{"subject":"burberry","relation":"made_of","object":"Gabardine"}]',
}


@query(
    """WITH w AS (SELECT doc_id, i, substr(text, i * 2300 + 1, 2500) AS t FROM documents, LATERAL (SELECT unnest(range(0, (length(text) + 2299) // 2300)) AS i)),
    r AS (SELECT doc_id, CASE WHEN contains(t, 'ción') THEN 1 WHEN contains(t, 'lich') THEN 2 WHEN contains(t, 'tion') THEN 3 END AS rule FROM w),
    f AS (SELECT rule, min(doc_id) AS doc_id FROM r WHERE rule IS NOT NULL GROUP BY 1), n AS (SELECT doc_id, sum(n) AS n FROM f JOIN (VALUES (1, 2), (2, 1), (3, 1)) v(rule, n) USING (rule) GROUP BY 1)
    SELECT doc_id AS ord, source AS title, coalesce(n, 0)::BIGINT AS added FROM documents LEFT JOIN n USING (doc_id)"""
)
def kg_build_from_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of all texts, a stand-in model that replies by what it reads, parsed and counted triples."""
    docs = documents(spark, sf_dir).select("ord", F.col("source").alias("title"), "text")
    return knowledge.build_graph(docs, models.EchoModel(_RULES), windows_per_doc=None)[1]


@query(
    """SELECT a.n_name AS a, b.n_name AS b, 2 AS hops, 'How are ' || a.n_name || ' and ' || b.n_name || ' connected in the world of fashion?' AS user,
    'They connect through the graph: ' || a.n_name || ' —part_of→ ' || r_name || ' —part_of→ ' || b.n_name || '.' AS assistant
    FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey JOIN region ON r_regionkey = a.n_regionkey ORDER BY md5(a.n_name || '|' || b.n_name || ':42'), a, b LIMIT 60"""
)
def kg_path_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    houses = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("house"))
    return knowledge.path_questions(star_triples(spark, sf_dir), houses, max_hops=2, unaccent=False)


class Suggester:
    """A stand-in model that replies with likely facts of the entity it is asked about, in several spellings, and with one of another."""

    def complete(self, prompt: str, system: str = "", max_tokens: int = 512) -> str:
        name = prompt.partition("Entity: ")[2].partition("\n")[0]
        told = [(name, "based_in", "Atlantis"), (name.replace("#", " "), "located_in", "atlantis"), ("Dior", "based_in", "Paris"), (name, "famous_for", "patience"), (name, "part_of", name)]
        return json.dumps([{"subject": s, "relation": r, "object": o} for s, r, o in told])


@query(f"SELECT {_KEY.format('s_name')} AS subject_key, relation, object_key, rank FROM supplier, (VALUES ('based_in', 'atlantis', 1), ('known_for', 'patience', 2)) v(relation, object_key, rank)")
def kg_predicted_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier is asked about; repeats, loops and facts of others fall out of the replies."""
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("ord"), F.col("s_name").alias("entity"))
    found = knowledge.predict_links(names, star_triples(spark, sf_dir), Suggester(), unaccent=False)
    return found.select("subject_key", "relation", "object_key", "rank")


class Mirror:
    """A stand-in model that answers with what it was given; as a judge it prefers the answer it reads first."""

    def complete(self, prompt: str, system: str = "", max_tokens: int = 512) -> str:
        return "It states more.\nVERDICT: A" if "VERDICT" in system else prompt


_ASKED = "'What are the key facts about ' || e || ': founder, seat, creative director, materials and silhouettes, influences, and what it is known for?'"


@query(
    f"""WITH {KG}, top AS (SELECT min(subject) AS e, subject_key, count(*) AS n FROM triples GROUP BY subject_key ORDER BY n DESC, subject_key LIMIT 8),
    s AS (SELECT subject_key AS key, * FROM triples UNION ALL SELECT object_key, * FROM triples WHERE object_key <> subject_key),
    f AS (SELECT key, string_agg('- ' || subject || ' ' || replace(relation, '_', ' ') || ' ' || object, chr(10) ORDER BY ord) AS facts FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord) AS nth FROM s WHERE key IN (SELECT subject_key FROM top) QUALIFY nth <= 20) GROUP BY 1),
    g AS (SELECT e, object, lower('Knowledge:' || chr(10) || 'Knowledge-graph facts:' || chr(10) || facts || chr(10) || chr(10) || 'Question: ' || {_ASKED}) AS kg, lower('Knowledge:' || chr(10) || '(none)' || chr(10) || chr(10) || 'Question: ' || {_ASKED}) AS rag
      FROM top JOIN triples USING (subject_key) JOIN f ON key = subject_key)
    SELECT e AS entity, count(*)::INTEGER AS n_gold, round(avg(contains(kg, lower(object))::INTEGER), 3) AS coverage_kg, round(avg(contains(rag, lower(object))::INTEGER), 3) AS coverage_rag,
    CASE WHEN ('0x' || substr(md5(e || ':42'), 1, 1))::INTEGER % 2 = 0 THEN 'kg' ELSE 'rag' END AS judge FROM g GROUP BY e"""
)
def kg_answer_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lift harness with a model that mirrors its knowledge and, as a blind judge, prefers what it reads first."""
    return knowledge.answers_of_arms(star_triples(spark, sf_dir), Mirror(), judge=True)


# -- vectors -----------------------------------------------------------------------------------------------------

VEC = """v AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-8)) AS e FROM embeddings),
sims AS (SELECT a.vec_id AS q, b.vec_id AS r, a.label AS ql, b.label AS rl, round(list_dot_product(a.e, b.e), 10) AS sim FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 10 = 0),
hits AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, r) AS rank FROM sims QUALIFY rank <= 12)"""


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")


def hits(spark: SparkSession, sf_dir: str, k: int = 12) -> DataFrame:
    rows = embeddings(spark, sf_dir)
    return S.top_k(rows.filter("vec_id % 10 = 0"), rows, k, "vec_id", "embedding", exclude_self=True, row_cols=("label",))


@query(f"WITH {VEC} SELECT q AS query_id, rank::INTEGER AS rank, r AS row_id, round(sim, 4) AS score FROM hits")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir).select("query_id", "rank", "row_id", "score")


def cell_index(spark: SparkSession, sf_dir: str) -> cells.CellIndex:
    """The table's index: built once a session while the table stays the same."""
    key = (spark.sparkContext.applicationId, stamp(spark, f"{sf_dir}/embeddings.parquet"))
    if key not in _indexes:
        _indexes[key] = cells.build_index(embeddings(spark, sf_dir), shared_path(spark, "cells"))
    return _indexes[key]


_indexes: dict[tuple, cells.CellIndex] = {}


@query(None)
def ann_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector's ten nearest others by the cell index, with the rows it was scored against."""
    asked, index = embeddings(spark, sf_dir).filter("vec_id % 50 = 0"), cell_index(spark, sf_dir)
    return cells.search(index, asked, 10, exclude_self=True).join(cells.candidates(index, asked), "query_id").select("query_id", "rank", "row_id", "score", "candidates")


@query(f"WITH {VEC.replace('% 10', '% 50').replace('<= 12', '<= 10')} SELECT count(DISTINCT q) AS queries, count(*) AS wanted, true AS recall_90, true AS fewer_rows FROM hits")
def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index against exact search: whether 0.9 of the true neighbours are found among fewer rows than there are."""
    rows, index = embeddings(spark, sf_dir), cell_index(spark, sf_dir)
    asked = rows.filter("vec_id % 50 = 0")
    told = cells.recall(cells.search(index, asked, 10, exclude_self=True), S.top_k(asked, rows, 10, "vec_id", "embedding", exclude_self=True))
    scored = cells.candidates(index, asked).agg(F.avg("candidates").alias("c")).crossJoin(index.cells().agg(F.sum("n").alias("n")))  # single rows
    return told.crossJoin(scored).select("queries", "wanted", (F.col("recall") >= 0.9).alias("recall_90"), (F.col("c") < F.col("n")).alias("fewer_rows"))


@query(f"WITH {VEC}, s AS (SELECT q, rl::VARCHAR AS label, round(sum(round(sim, 4)), 6) AS raw FROM hits GROUP BY 1, 2) SELECT q AS query_id, label, round(raw, 3) AS score, row_number() OVER (PARTITION BY q ORDER BY raw DESC, label)::INTEGER AS place FROM s")
def knn_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.votes(hits(spark, sf_dir), F.col("label")).select("query_id", "label", "score", "place")


_CENTROIDS = f"""{VEC}, m AS (SELECT label, i, avg(e[i]) AS m FROM v, range(1, 65) t(i) GROUP BY 1, 2), c0 AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY 1),
c AS (SELECT label, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS c FROM c0)"""


@query(f"WITH {_CENTROIDS} SELECT label, round(c[1], 6) AS x1, round(c[64], 6) AS x64, round(list_dot_product(c, c), 6) AS n FROM c")
def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.centroids(embeddings(spark, sf_dir), "label", "embedding")
    return c.select("label", F.round(F.element_at("centroid", 1), 6).alias("x1"), F.round(F.element_at("centroid", 64), 6).alias("x64"), F.round(V.dot(F.col("centroid"), F.col("centroid")), 6).alias("n"))


@query(f"WITH {_CENTROIDS}, s AS (SELECT vec_id, c.label, round(list_dot_product(v.e, c.c), 8) AS sim FROM v, c) SELECT vec_id AS id, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label)::INTEGER AS rank, label, round(sim, 4) AS score FROM s QUALIFY rank <= 3")
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir)
    return S.nearest_prototypes(rows, S.centroids(rows, "label", "embedding"), "vec_id", "embedding").select("id", "rank", "label", "score")


_ACCURACY = """s AS (SELECT t.q, t.ql, r.rl, r.sim, row_number() OVER (PARTITION BY t.q ORDER BY r.sim DESC, r.r) AS rank FROM (SELECT vec_id AS q, label AS ql FROM v WHERE {held}) t JOIN
(SELECT a.vec_id AS q, b.vec_id AS r, b.label AS rl, round(list_dot_product(a.e, b.e), 10) AS sim FROM v a, v b WHERE ({held_a}) AND NOT ({held_b})) r ON r.q = t.q QUALIFY rank <= 12),
p AS (SELECT q, any_value(ql) AS ql, rl, round(sum(sim), 6) AS raw FROM s GROUP BY q, rl), o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY raw DESC, rl::VARCHAR) AS place FROM p),
t AS (SELECT vec_id AS q, label AS ql FROM v WHERE {held}), h AS (SELECT t.q, coalesce(max(CASE WHEN o.rl = t.ql THEN o.place END), 1000) AS place FROM t LEFT JOIN o ON o.q = t.q GROUP BY 1)
SELECT round(avg((place <= 1)::INTEGER), 3) AS top1, round(avg((place <= 3)::INTEGER), 3) AS top3, round(avg((place <= 5)::INTEGER), 3) AS top5, count(*) AS n_test FROM h"""


def _accuracy(spark: SparkSession, sf_dir: str, key) -> DataFrame:
    rows = evaluation.split(embeddings(spark, sf_dir), key, 0.2)
    held, known = rows.filter("held_out"), rows.filter("NOT held_out")
    voted = S.votes(S.top_k(held, known, 12, "vec_id", "embedding", row_cols=("label",)), F.col("label"), round_first=False)
    return S.top_k_accuracy(voted, held.select(F.col("vec_id").alias("query_id"), F.col("label").cast("string").alias("true_label")))


_ROWS_HELD = "{0} IN (SELECT vec_id FROM v ORDER BY md5(vec_id::VARCHAR || ':42'), vec_id::VARCHAR LIMIT (SELECT greatest(1, floor(count(*) * 0.2))::BIGINT FROM v))"
_GROUPS = "g AS (SELECT DISTINCT label::VARCHAR || '|' || (vec_id % 7)::VARCHAR AS k FROM v)"
_GROUPS_HELD = "{0} IN (SELECT k FROM g ORDER BY md5(k || ':42'), k LIMIT (SELECT greatest(1, floor(count(*) * 0.2))::BIGINT FROM g))"


@query(f"WITH {VEC}, " + _ACCURACY.format(held=_ROWS_HELD.format("vec_id"), held_a=_ROWS_HELD.format("a.vec_id"), held_b=_ROWS_HELD.format("b.vec_id")))
def topk_accuracy_row_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accuracy(spark, sf_dir, F.col("vec_id"))


@query(f"WITH {VEC}, {_GROUPS}, " + _ACCURACY.format(held=_GROUPS_HELD.format("(label::VARCHAR || '|' || (vec_id % 7)::VARCHAR)"), held_a=_GROUPS_HELD.format("(a.label::VARCHAR || '|' || (a.vec_id % 7)::VARCHAR)"), held_b=_GROUPS_HELD.format("(b.label::VARCHAR || '|' || (b.vec_id % 7)::VARCHAR)")))
def topk_accuracy_group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accuracy(spark, sf_dir, F.concat_ws("|", F.col("label").cast("string"), (F.col("vec_id") % 7).cast("string")))


#: Hits of resamples by the inverse binomial distribution, from h(n, won).
_RESAMPLED = """pmf AS (SELECT k, n, exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(won / n) + (n - k) * ln(1 - won / n)) AS p FROM h, LATERAL (SELECT unnest(range(0, n + 1)) AS k) WHERE won > 0 AND won < n),
cdf AS MATERIALIZED (SELECT k, n, sum(p) OVER (ORDER BY k) AS c FROM pmf), u AS (SELECT ('0x' || substr(md5(i::VARCHAR || ':42'), 1, 12))::BIGINT / 281474976710656 AS u FROM range(0, {0}) t(i)),
m AS (SELECT min(k) / any_value(n) AS m FROM (SELECT row_number() OVER () AS i, u FROM u) JOIN cdf ON c >= u GROUP BY i)"""


@query(f"WITH h AS (SELECT count(*) AS n, sum((vec_id % 3 = 0)::INTEGER) AS won FROM embeddings), {_RESAMPLED.format(2000)} SELECT round(quantile_cont(m, 0.025), 3) AS lo, round(quantile_cont(m, 0.975), 3) AS hi FROM m")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.bootstrap_ci(embeddings(spark, sf_dir), F.col("vec_id") % 3 == 0)


@query(
    f"""WITH {VEC}, l AS (SELECT q, 0 AS list_id, rank, r AS item FROM hits UNION ALL SELECT q, 1, row_number() OVER (PARTITION BY q ORDER BY r), r FROM hits),
    f AS (SELECT q, item, round(sum(1 / (60 + rank)), 10) AS score, min(list_id * 1000 + rank) AS first FROM l GROUP BY 1, 2)
    SELECT q AS query_id, item, round(score, 6) AS score, row_number() OVER (PARTITION BY q ORDER BY score DESC, first)::INTEGER AS place FROM f QUALIFY place <= 5"""
)
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hits(spark, sf_dir)
    second = F.row_number().over(W.partitionBy("query_id").orderBy("row_id"))
    lists = h.select("query_id", F.lit(0).alias("list_id"), "rank", F.col("row_id").alias("item")).unionByName(h.select("query_id", F.lit(1).alias("list_id"), second.alias("rank"), F.col("row_id").alias("item")))
    return fusion.reciprocal_rank_fusion(lists, 60, 5, ("query_id",)).withColumn("score", F.round("score", 6))


@query(
    f"""WITH {VEC}, a AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, r) AS r1 FROM sims QUALIFY r1 <= 20),
    b AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY (r % 13) DESC, r1) AS r2 FROM a),
    f AS (SELECT q, r, round(1 / (60 + r1) + 1 / (60 + r2), 10) AS score, r1 FROM b) SELECT q AS query_id, r AS item, row_number() OVER (PARTITION BY q ORDER BY score DESC, r1)::INTEGER AS place FROM f QUALIFY place <= 5"""
)
def pool_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hits(spark, sf_dir, k=20)
    scored = h.select("query_id", F.col("row_id").alias("item"), F.col("sim").alias("first"), (F.col("row_id") % 13).alias("second"))
    return fusion.pool_then_rerank(scored, 5).select("query_id", "item", "place")


@query(f"WITH {VEC} SELECT q AS query_id, row_number() OVER (PARTITION BY q ORDER BY sim DESC, r)::INTEGER AS rank, r AS row_id, round(1 - sim, 4) AS distance FROM sims WHERE rl IN (1, 2, 3) QUALIFY rank <= 5")
def retrieve_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir)
    found = S.top_k(rows.filter("vec_id % 10 = 0"), rows.filter(F.col("label").isin(1, 2, 3)), 5, "vec_id", "embedding", exclude_self=True)
    return found.select("query_id", "rank", "row_id", F.round(1 - F.col("sim"), 4).alias("distance"))


@query(
    f"""WITH {KG}, {VEC}, p AS (SELECT 'Supplier#' || lpad((vec_id + 1)::VARCHAR, 9, '0') AS label, e FROM v WHERE vec_id < 20),
    n AS (SELECT v.vec_id AS id, p.label AS entity, list_dot_product(v.e, p.e) AS sim, row_number() OVER (PARTITION BY v.vec_id ORDER BY round(list_dot_product(v.e, p.e), 10) DESC, p.label) AS rank FROM v, p QUALIFY rank <= 3),
    s AS (SELECT subject_key AS key, * FROM triples UNION ALL SELECT object_key, * FROM triples WHERE object_key <> subject_key),
    f AS (SELECT key, string_agg(subject || ' ' || replace(relation, '_', ' ') || ' ' || object, '; ' ORDER BY ord) AS facts FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord) AS nth FROM s QUALIFY nth <= 6) GROUP BY 1)
    SELECT id, rank::INTEGER AS rank, entity, round(sim, 4) AS score, coalesce(facts, '') AS facts FROM n LEFT JOIN f ON key = replace(lower(entity), '#', ' ')"""
)
def link_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's nearest of twenty prototypes, named after suppliers, with their first facts."""
    rows = embeddings(spark, sf_dir)
    named = F.concat(F.lit("Supplier#"), F.lpad((F.col("vec_id") + 1).cast("string"), 9, "0"))
    prototypes = rows.filter("vec_id < 20").select(named.alias("label"), V.normalized(F.col("embedding")).alias("centroid"))
    found = knowledge.link(rows, prototypes, star_triples(spark, sf_dir), "vec_id", "embedding", unaccent=False)
    return found.withColumn("facts", F.array_join("facts", "; "))


_REPORT = _ACCURACY.format(held=_ROWS_HELD.format("vec_id"), held_a=_ROWS_HELD.format("a.vec_id"), held_b=_ROWS_HELD.format("b.vec_id")).replace("h AS (SELECT t.q", "w AS MATERIALIZED (SELECT t.q").replace("FROM h", "FROM w").replace("count(*) AS n_test", "count(*) AS n_test, (SELECT count(DISTINCT label) FROM v) AS n_labels, round(1.0 / (SELECT count(DISTINCT label) FROM v), 3) AS random_top1, 'row' AS split_by")
_REPORT, _TOPS = _REPORT[: _REPORT.rindex("SELECT round(avg")], _REPORT[_REPORT.rindex("SELECT round(avg") :]


@query(f"WITH {VEC}, {_REPORT}, h AS (SELECT count(*) AS n, sum((place <= 1)::INTEGER) AS won FROM w), {_RESAMPLED.format(2000)}, i AS (SELECT round(quantile_cont(m, 0.025), 3) AS lo, round(quantile_cont(m, 0.975), 3) AS hi FROM m) SELECT r.*, lo, hi FROM ({_TOPS}) r, i")
def accuracy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluation.split(embeddings(spark, sf_dir), F.col("vec_id"), 0.2)
    return S.accuracy_report(rows, F.col("held_out"), "vec_id", "label", "embedding", 12, iterations=2000)


@query(
    f"""WITH v AS (SELECT vec_id, label FROM embeddings), {_GROUPS}, o AS (SELECT k, row_number() OVER (ORDER BY md5(k || ':42'), k) AS r FROM g), n AS (SELECT greatest(1, floor(count(*) * 0.2)) AS t, greatest(1, floor(count(*) * 0.15)) AS a FROM g)
    SELECT vec_id, CASE WHEN r <= t THEN 'test' WHEN r <= t + a THEN 'valid' ELSE 'train' END AS part FROM v JOIN o ON k = label::VARCHAR || '|' || (vec_id % 7)::VARCHAR, n"""
)
def three_way_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws("|", F.col("label").cast("string"), (F.col("vec_id") % 7).cast("string"))
    return evaluation.three_way(embeddings(spark, sf_dir), key).select("vec_id", "part")


_W = [[((7 * i + 3 * j) % 11 - 5) / 10 for j in range(64)] for i in range(4)]


@query(f"WITH {VEC}, p AS (SELECT vec_id, list_transform({_W!r}::DOUBLE[][], lambda w: list_dot_product(w, e)) AS p FROM v) SELECT vec_id, round(p[1] / sqrt(list_dot_product(p, p)), 6) AS x1, round(p[4] / sqrt(list_dot_product(p, p)), 6) AS x4 FROM p")
def project_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = embeddings(spark, sf_dir).select("vec_id", V.project(V.normalized(F.col("embedding")), V.matrix(_W)).alias("p"))
    return p.select("vec_id", F.round(F.element_at("p", 1), 6).alias("x1"), F.round(F.element_at("p", 4), 6).alias("x4"))


@query(f"WITH {VEC}, p AS (SELECT vec_id, 1 / (1 + exp(-(list_dot_product(list_transform({_W!r}::DOUBLE[][], lambda w: greatest(list_dot_product(w, e) + 0.1, 0)), [1.0, -1.0, 0.5, 2.0]) + 0.05))) AS s FROM v) SELECT vec_id, round(s, 6) AS score, round_even(100 * s, 0)::INTEGER AS score_100 FROM p")
def mlp_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.relu_mlp(V.normalized(F.col("embedding")), V.matrix(_W), F.array(*[F.lit(0.1)] * 4), F.array(*map(F.lit, (1.0, -1.0, 0.5, 2.0))), 0.05)
    return embeddings(spark, sf_dir).select("vec_id", s.alias("s")).select("vec_id", F.round("s", 6).alias("score"), V.score_100(F.col("s")).alias("score_100"))


_BATCH = f"{VEC}, b AS (SELECT vec_id // 64 AS t, vec_id AS id, label, e FROM v)"


def batch_of():
    """Every row of the table takes part, in batches of up to 64 as a training step has them."""
    return F.floor(F.col("id") / 64)


@query(
    f"""WITH {_BATCH}, s AS (SELECT a.t, a.id AS i, c.id AS j, 10 * list_dot_product(a.e, list_reverse(c.e)) AS s FROM b a JOIN b c ON a.t = c.t),
    r AS (SELECT t, i, ln(sum(exp(s))) AS l, max(CASE WHEN i = j THEN s END) AS o FROM s GROUP BY 1, 2), k AS (SELECT t, j, ln(sum(exp(s))) AS l, max(CASE WHEN i = j THEN s END) AS o FROM s GROUP BY 1, 2),
    x AS (SELECT t, avg(l - o) AS x FROM r GROUP BY 1), y AS (SELECT t, avg(l - o) AS y FROM k GROUP BY 1) SELECT round(avg((x + y) / 2), 6) AS loss FROM x JOIN y USING (t)"""
)
def infonce_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("embedding").alias("image"), F.reverse("embedding").alias("text"))
    return models.info_nce(rows, 10.0, batch_of()).withColumn("loss", F.round("loss", 6))


@query(
    f"""WITH {_BATCH}, s AS (SELECT a.t, a.id AS i, c.id AS j, a.label = c.label AS same, list_dot_product(a.e, c.e) / 0.1 AS s FROM b a JOIN b c ON a.t = c.t AND a.id <> c.id),
    l AS (SELECT i, ln(sum(exp(s))) AS l FROM s GROUP BY 1), w AS (SELECT t, i, avg(s - l) AS x FROM s JOIN l USING (i) WHERE same GROUP BY 1, 2), m AS (SELECT t, avg(-x) AS m FROM w GROUP BY 1) SELECT round(avg(m), 6) AS loss FROM m"""
)
def supcon_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir).select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))
    w = supervision.weights(rows.select(F.col("label").alias("owner"), F.lit("").alias("concept")).distinct(), "labels")
    return models.supervised_contrastive(rows, w, batch=batch_of()).withColumn("loss", F.round("loss", 6))


@query("SELECT count(*) AS n_rows, count(DISTINCT label) AS n_labels, true AS loss_fell, true AS top1_rose FROM embeddings WHERE label IS NOT NULL")
def projection_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A projection trained on all labelled vectors: whether its loss falls and more of them lie nearest to a vector of their own label."""
    rows = embeddings(spark, sf_dir).filter("label IS NOT NULL")
    w = supervision.weights(rows.select(F.col("label").alias("owner"), F.lit("").alias("concept")).distinct(), "labels")
    fitted, _ = training.train_projection(rows, w, None, "vec_id", "label", "embedding", epochs=5, rate=0.03)
    plain = np.eye(len(fitted))
    before, after = training.projection_losses(rows, w, [plain, fitted], "vec_id", "label", "embedding")

    def top1(projection: np.ndarray) -> float:
        told = materialise(training.projected(rows, projection, "vec_id", "embedding").join(rows.select(F.col("vec_id").alias("id"), "label"), "id"), "projected")
        first = S.top_k(told, told, 1, "id", "v", exclude_self=True, query_cols=("label",))
        own = told.select(F.col("id").alias("row_id"), F.col("label").alias("row_label"))
        return first.join(own, "row_id").agg(F.avg((F.col("label") == F.col("row_label")).cast("int"))).first()[0]

    rose = top1(fitted) > top1(plain)
    return rows.agg(F.count("*").alias("n_rows"), F.countDistinct("label").alias("n_labels")).select("*", F.lit(after < before).alias("loss_fell"), F.lit(bool(rose)).alias("top1_rose"))


def describe_part(image: bytes, prompt: str, system: str) -> str:
    """A stand-in for a model that looks at pictures: it fails on some and says of others what their bytes spell."""
    name, size = image.decode().split("|")
    if int(size) % 10 == 9:
        raise ValueError("cannot see")
    return json.dumps({"caption": f"A {name} look", "materials": [f"grade {int(size) % 5}"], "silhouettes": None})


@query(
    """WITH l AS (SELECT p_partkey, p_brand AS designer, p_name AS show, p_size, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY lpad(p_partkey::VARCHAR, 9, '0')) AS nth FROM part),
    s AS (SELECT * FROM l WHERE nth <= 3 AND p_size % 10 <> 9), t AS (SELECT designer, count(DISTINCT p_size % 5) AS n FROM s GROUP BY 1)
    SELECT 1 AS run, designer, count(*) AS looks, count(*) AS captions, any_value(t.n) AS triples_added FROM s JOIN t USING (designer) GROUP BY designer
    UNION ALL SELECT 2, '(again)', 0, 0, 0"""
)
def runway_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as looks of their brands: three of each collection are described, parsed and stored; a second run finds nothing left."""
    looks = table(spark, sf_dir, "part").select(F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("look"), F.col("p_brand").alias("designer"), F.col("p_name").alias("show"), F.lit("").alias("season"), F.concat_ws("|", "p_name", F.col("p_size").cast("string")).cast("binary").alias("image"))
    at, runs = shared_path(spark, "runway"), []
    for run in (1, 2):
        told = runway.extract(looks, describe_part, f"{at}/captions", f"{at}/triples", unaccent=False)
        runs.append(materialise(told.select(F.lit(run).alias("run"), "designer", "looks", "captions", "triples_added"), "run"))
    again = runs[1].agg(F.lit(2).alias("run"), F.lit("(again)").alias("designer"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("looks", "captions", "triples_added")))
    return runs[0].unionByName(again)


# -- sources and sinks: given tables written, read back and compared ---------------------------------------------


@query(f"WITH {VEC} SELECT vec_id, label, round(e[1]::FLOAT::DOUBLE, 5) AS x1, round(e[64]::FLOAT::DOUBLE, 5) AS x64, round(list_dot_product(e, e), 4) AS norm FROM v")
def sink_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector index: written normalised, opened again."""
    path = shared_path(spark, "vectors")
    sinks.write_vectors(embeddings(spark, sf_dir), path)
    v = F.col("embedding")
    at = lambda i: F.round(F.element_at(v, i).cast("double"), 5).alias(f"x{i}")
    return sinks.read_vectors(spark, path).select("vec_id", "label", at(1), at(64), F.round(V.dot(v, v), 4).alias("norm"))


@query("SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'changed' ELSE event_type END AS kind, value FROM events UNION ALL SELECT event_id + 10000000, 'added', value FROM events WHERE event_id % 7 = 0")
def sink_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upsert store: all events, then a third of them changed and some more added."""
    path = shared_path(spark, "store")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), "value")
    sinks.upsert_rows(rows, path)
    changed = rows.filter("id % 3 = 0").withColumn("kind", F.lit("changed"))
    added = rows.filter("id % 7 = 0").select((F.col("id") + 10_000_000).alias("id"), F.lit("added").alias("kind"), "value")
    sinks.upsert_rows(changed.unionByName(added), path)
    return sinks.read_rows(spark, path)


@query(f"WITH {KG}, n AS (SELECT count(*) AS n, count(*) FILTER (relation = 'based_in') AS b FROM triples) SELECT 1 AS run, b AS added, b AS stored, true AS read_less FROM n UNION ALL SELECT 2, n - b, n, true FROM n UNION ALL SELECT 3, 0, n, true FROM n")
def sink_keyed_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples into a keyed store: those of one relation, then all, then all again; new keys read fewer pieces than there are."""
    store, every = keyed_store.triple_store(spark, shared_path(spark, "triples")), materialise(star_triples(spark, sf_dir), "star")
    runs = []
    for i, rows in enumerate((every.filter("relation = 'based_in'"), every, every), 1):
        pieces = store.filters().count()
        added, read = store.insert(rows)
        runs.append((i, added, store.rows().count(), read <= pieces))
    return spark.createDataFrame(runs, "run int, added long, stored long, read_less boolean")


@query(
    f"""WITH {_TURNS}, e AS (SELECT conv_id * 1000 + turn AS ord, i AS u, o FROM turns WHERE i <> '' AND o <> ''), d AS (SELECT u, min(ord) AS ord FROM e GROUP BY u), n AS (SELECT greatest(1, floor(count(*) * 0.1)::BIGINT) AS n FROM d),
    v AS (SELECT *, row_number() OVER (ORDER BY md5(u || ':42'), u) AS r FROM d) SELECT v.ord, CASE WHEN r <= n THEN 'valid' ELSE 'train' END AS part, sha1(v.u) AS user_sha1, sha1(e.o) AS reply_sha1 FROM v JOIN e USING (ord), n"""
)
def sink_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat examples as JSON lines, train and valid apart, read back with their messages."""
    rows = turns(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.trim("input").alias("user"), F.trim("completion").alias("assistant")).filter("user <> '' AND assistant <> ''")
    told = supervision.train_valid(supervision.first_per_user_turn(rows, "ord"), F.col("user"))
    path = shared_path(spark, "split")
    sinks.write_split(told.select("ord", "part", supervision.chat(F.col("user"), F.col("assistant")).alias("messages")), path)
    got = spark.read.schema("ord long, part string, messages array<struct<role string, content string>>").json(path)
    said = lambda i: F.sha1(F.element_at("messages", i)["content"].cast("binary"))
    return got.select("ord", "part", said(2).alias("user_sha1"), said(3).alias("reply_sha1"))


@query("SELECT role AS designer, 2 * count(*) AS captions, sum(length(trim(text)))::BIGINT * 2 AS characters FROM conversations WHERE coalesce(trim(text), '') <> '' GROUP BY 1")
def sink_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions are appended: two runs leave each non-empty one twice."""
    path = shared_path(spark, "captions")
    for _ in (1, 2):
        sinks.append_captions(table(spark, sf_dir, "conversations").select(F.col("role").alias("designer"), F.trim("text").alias("caption")), path)
    got = spark.read.schema("designer string, caption string").json(path)
    return got.groupBy("designer").agg(F.count("*").alias("captions"), F.sum(F.length("caption")).alias("characters"))


@query("SELECT count(DISTINCT (event_type, day(ts), user_id)) AS passages, count(DISTINCT event_type) AS elements FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL")
def sink_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experts' annotations go into the chunk store once, however often they are sent."""
    path = shared_path(spark, "annotations")
    rows = table(spark, sf_dir, "events").filter("event_type IS NOT NULL AND user_id IS NOT NULL").select(F.col("event_type").alias("element"), F.lit("day").alias("season"), F.dayofmonth("ts").alias("year"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("context"))
    for _ in (1, 2):
        sinks.add_annotations(rows, path, lambda c: F.array(F.length(c).cast("double")))
    got = sinks.read_rows(spark, path)
    return got.agg(F.count("*").alias("passages"), F.countDistinct(F.regexp_extract("chunk", "analysis: ([a-z]+) in", 1)).alias("elements"))


@query("SELECT p_name || '. articleType: ' || lower(p_type) || '; season: ' || CASE WHEN p_size > 25 THEN 'Winter' ELSE 'Summer' END AS text, p_name AS title, lower(p_type) AS category, count(*) AS n FROM part GROUP BY ALL")
def source_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue in Parquet and in CSV files, with the name under different columns, read as documents."""
    root, rows = shared_path(spark, "catalogue"), table(spark, sf_dir, "part")
    kept = [F.lower("p_type").alias("articleType"), F.when(F.col("p_size") > 25, "Winter").otherwise("Summer").alias("season")]
    rows.filter("p_partkey % 2 = 0").select(F.col("p_name").alias("productDisplayName"), *kept).write.parquet(f"{root}/a")
    rows.filter("p_partkey % 2 = 1").select(*kept, F.col("p_name").alias("title")).write.option("header", "true").csv(f"{root}/b")
    meta = F.col("metadata")
    return files.fashion_products(spark, root).groupBy("text", meta["title"].alias("title"), meta["category"].alias("category")).agg(F.count("*").alias("n"))


@query(f"WITH {_TURNS} SELECT sha1('Styling example. Profile: ' || i || '. Occasion: . Advice: ' || o) AS h, count(*) AS n FROM turns WHERE o <> '' GROUP BY 1")
def source_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction records from Parquet files with the answer under either name."""
    root, rows = shared_path(spark, "instructions"), turns(spark, sf_dir)
    rows.filter("conv_id % 2 = 0").select("input", "completion").write.parquet(f"{root}/a")
    rows.filter("conv_id % 2 = 1").select("input", F.col("completion").alias("response")).write.parquet(f"{root}/b")
    return files.style_instructions(spark, root).groupBy(F.sha1(F.col("text").cast("binary")).alias("h")).agg(F.count("*").alias("n"))


@query("SELECT event_type AS element, day(ts)::INTEGER AS year, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2")
def source_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trend annotations from CSV files with a header."""
    path = shared_path(spark, "trends")
    annotations(spark, sf_dir).filter("element IS NOT NULL").select("element", F.lit("x, \"y\"").alias("context"), "year", "trend_score").write.option("header", "true").option("escape", '"').csv(path)
    return files.trend_annotations(spark, path).groupBy("element", "year").agg(F.count("*").alias("n"), F.round(F.sum("trend_score"), 2).alias("total"))


@query("SELECT count(*) AS lines, sum(length(text) - length(replace(text, chr(10), '')))::BIGINT AS breaks FROM (SELECT replace(replace(text, chr(13), ' '), chr(10), ' ') AS text FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)")
def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text files, a line each, read by the data source of lines."""
    path = shared_path(spark, "lines")
    flat = F.regexp_replace("text", r"[\r\n]", " ")
    table(spark, sf_dir, "documents").filter("text IS NOT NULL AND doc_id IS NOT NULL").select(flat.alias("value")).write.text(path)
    return read_lines(spark, path).agg(F.count("*").alias("lines"), F.sum(F.length("value") - F.length(F.replace("value", F.lit("\n"), F.lit("")))).alias("breaks"))


# -- pairs, trends, regions --------------------------------------------------------------------------------------


_DRAWN = "('0x' || substr(md5(draw::VARCHAR || ':{0}:42'), 1, 12))::BIGINT % n"


@query(
    f"""WITH s AS (SELECT id, s, row_number() OVER (ORDER BY md5(id || ':42'), id) - 1 AS place FROM (SELECT p_partkey::VARCHAR AS id, p_retailprice AS s FROM part) WHERE s IS NOT NULL), n AS (SELECT count(*) AS n FROM s),
    d AS (SELECT draw, {_DRAWN.format('a')} AS a, {_DRAWN.format('b')} AS b FROM range(0, 15000) r(draw), n),
    p AS (SELECT draw, CASE WHEN x.s > y.s THEN x.id ELSE y.id END AS winner, CASE WHEN x.s > y.s THEN y.id ELSE x.id END AS loser FROM d JOIN s x ON x.place = a JOIN s y ON y.place = b WHERE a <> b AND abs(x.s - y.s) >= 50)
    SELECT winner, loser, min(draw) AS draw FROM p GROUP BY 1, 2 ORDER BY draw LIMIT 500"""
)
def pairwise_margin_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supervision.margin_pairs(table(spark, sf_dir, "part"), 50, 500, "p_partkey", "p_retailprice")


@query(
    """WITH s AS (SELECT doc_id, quality, length(text) / 1000.0 AS s FROM labels JOIN documents USING (doc_id)), p AS (SELECT w.s AS w, l.s AS l FROM s w JOIN s l ON l.doc_id - w.doc_id BETWEEN 1 AND 8 AND w.quality = 1 AND l.quality = 0)
    SELECT round(avg(ln(1 + exp(-(w - l)))), 6) AS loss, round(avg((w > l)::INTEGER), 6) AS accuracy FROM p"""
)
def pair_accuracy_bt_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each good document against the poor ones among the eight after it: the pairs are joined to both sides' features."""
    labels = table(spark, sf_dir, "labels")
    near = labels.filter("quality = 1").select(F.col("doc_id").alias("winner"), F.explode(F.sequence(F.col("doc_id") + 1, F.col("doc_id") + 8)).alias("loser"))
    pairs = near.join(labels.filter("quality = 0").select(F.col("doc_id").alias("loser")), "loser", "left_semi")
    items = table(spark, sf_dir, "documents").select("doc_id", (F.length("text") / 1000).alias("s"))
    return models.pair_metrics(models.paired(pairs, items, "doc_id", "s"), "winner_s", "loser_s").select(F.round("loss", 6).alias("loss"), F.round("accuracy", 6).alias("accuracy"))


_TREND = "t AS (SELECT event_id AS ord, event_type AS element, day(ts) AS d, value AS s FROM events)"


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), F.col("event_type").alias("element"), F.dayofmonth("ts").alias("year"), F.col("value").alias("trend_score"))


@query(f"WITH {_TREND}, l AS (SELECT d, element, max_by(s, ord) AS s FROM t GROUP BY 1, 2) SELECT g.d::INTEGER AS d, e.element, coalesce(l.s, 0) AS score FROM (SELECT DISTINCT d FROM t) g CROSS JOIN (SELECT DISTINCT element FROM t) e LEFT JOIN l ON l.d = g.d AND l.element = e.element")
def trend_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.snapshots(annotations(spark, sf_dir)).withColumnRenamed("year", "d")


@query(
    """WITH n AS (SELECT 'n' || n_nationkey::VARCHAR AS src, 'r' || n_regionkey::VARCHAR AS dst FROM nation), l AS (SELECT src, dst FROM n UNION ALL SELECT dst, src FROM n),
    f AS (SELECT src AS node, length(src) + (hash_order.i * 0.5) AS x, hash_order.i AS i FROM (SELECT DISTINCT src FROM l), range(0, 2) hash_order(i)),
    a AS (SELECT src, dst FROM l UNION ALL SELECT DISTINCT node, node FROM f), d AS (SELECT dst AS k, count(*) AS d FROM a GROUP BY 1)
    SELECT a.dst AS node, f.i::INTEGER AS i, round(sum(f.x / sqrt(p.d * q.d)), 6) AS x FROM a JOIN d p ON p.k = a.src JOIN d q ON q.k = a.dst JOIN f ON f.node = a.src GROUP BY 1, 2"""
)
def gcn_propagate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("src"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("dst"))
    links = n.unionByName(n.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    features = links.select(F.col("src").alias("node")).distinct().select("node", F.posexplode(F.array(F.length("node") * 1.0, F.length("node") + 0.5)).alias("i", "x"))
    return graph.propagate(features, links).withColumn("x", F.round("x", 6))


#: Hidden units of the network below, and its weights: any fixed numbers.
_UNITS = 2


def network() -> dict[str, np.ndarray]:
    rng, h = np.random.default_rng(26), _UNITS
    shape = {"wg": (2, h), "bg": (h,), "w1": (h, h), "b1": (h,), "w2": (h, 1), "b2": (1,)} | {f"w{k}": (h, h) for k in "zrhqkv"} | {f"u{k}": (h, h) for k in "zrh"} | {f"b{k}": (h,) for k in "zrh"}
    return {k: rng.normal(0, 1, s) for k, s in shape.items()}


def _layer(x: str, w: str, f: str = "{0}", more: str = "", bias: str | None = None) -> str:
    """SQL of f(x * w + bias + more) unit by unit; ``x`` and ``more`` are lists."""
    p = network()
    units = []
    for i in range(p[w].shape[1]):
        column = "[" + ", ".join(repr(float(v)) for v in p[w][:, i]) + "]::DOUBLE[]"
        parts = [f"list_dot_product({x}, {column})"] + ([f"({more})[{i + 1}]"] if more else []) + ([repr(float(p[bias][i]))] if bias else [])
        units.append(f.format(" + ".join(f"({v})" for v in parts)))
    return "[" + ", ".join(units) + "]"


_SIGMOID = "(1 / (1 + exp(-({0}))))"
_LINKS = "l AS (SELECT DISTINCT a.user_id AS src, b.user_id AS dst FROM events a JOIN events b ON b.event_id = a.event_id + 1 AND a.event_type = 'purchase' AND b.event_type = 'purchase' WHERE a.user_id IS NOT NULL AND b.user_id IS NOT NULL), e AS (SELECT src, dst FROM l UNION SELECT dst, src FROM l)"


@query(
    f"""WITH RECURSIVE {_LINKS}, f AS (SELECT user_id AS node, day(ts) AS t, [sum(value) / 100, count(*) / 10]::DOUBLE[] AS x FROM events GROUP BY 1, 2),
    nodes AS (SELECT node FROM f UNION SELECT src FROM e), a AS (SELECT src, dst FROM e WHERE src <> dst UNION ALL SELECT node, node FROM nodes), d AS (SELECT dst AS k, count(*) AS d FROM a GROUP BY 1),
    s AS (SELECT a.dst AS node, f.t, [sum(f.x[1] / sqrt(p.d * q.d)), sum(f.x[2] / sqrt(p.d * q.d))]::DOUBLE[] AS x FROM a JOIN d p ON p.k = a.src JOIN d q ON q.k = a.dst JOIN f ON f.node = a.src GROUP BY 1, 2),
    seasons AS (SELECT t, row_number() OVER (ORDER BY t) AS i FROM (SELECT DISTINCT t FROM f)),
    g AS (SELECT nodes.node, i, {_layer("coalesce(s.x, [0, 0]::DOUBLE[])", "wg", "greatest({0}, 0)", bias="bg")}::DOUBLE[] AS x FROM nodes CROSS JOIN seasons LEFT JOIN s ON s.node = nodes.node AND s.t = seasons.t),
    r AS (SELECT node, 0::BIGINT AS i, [0, 0]::DOUBLE[] AS h, []::DOUBLE[][] AS states FROM nodes
      UNION ALL SELECT node, i, n, list_append(states, n) FROM (
        SELECT node, i, states, list_transform(range(1, {_UNITS + 1}), lambda k: (1 - z[k]) * y[k] + z[k] * h[k])::DOUBLE[] AS n FROM (
          SELECT *, {_layer("x", "wh", "((exp(2 * ({0})) - 1) / (exp(2 * ({0})) + 1))", more=_layer("list_transform(range(1, %d), lambda k: o[k] * h[k])::DOUBLE[]" % (_UNITS + 1), "uh"), bias="bh")}::DOUBLE[] AS y FROM (
            SELECT r.node, g.i, r.states, r.h, g.x, {_layer("g.x", "wz", _SIGMOID, more=_layer("r.h", "uz"), bias="bz")}::DOUBLE[] AS z, {_layer("g.x", "wr", _SIGMOID, more=_layer("r.h", "ur"), bias="br")}::DOUBLE[] AS o
            FROM r JOIN g ON g.node = r.node AND g.i = r.i + 1)))),
    last AS (SELECT node, states, {_layer("h", "wq")}::DOUBLE[] AS q FROM r WHERE i = (SELECT max(i) FROM seasons)),
    w AS (SELECT node, states, list_transform(states, lambda c: exp(list_dot_product(q, {_layer("c", "wk")}::DOUBLE[]) / sqrt({_UNITS}))) AS w FROM last),
    o AS (SELECT node, {_layer("list_transform(range(1, %d), lambda k: list_sum(list_transform(range(1, len(w) + 1), lambda j: w[j] * (%s)[k])) / list_sum(w))::DOUBLE[]" % (_UNITS + 1, _layer("states[j]", "wv")), "w1", "greatest({0}, 0)", bias="b1")}::DOUBLE[] AS v FROM w)
    SELECT node, round({_layer("v", "w2", _SIGMOID, bias="b2")}[1], 6) AS score FROM o"""
)
def temporal_gnn_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's score from the days' activity: users whose purchases follow each other are linked."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.dayofmonth("ts").alias("t"), "value", "event_type")
    days = events.groupBy("t", F.col("user_id").alias("node")).agg(F.array(F.sum("value") / 100, F.count("*") / 10).alias("x"))
    bought = events.filter("event_type = 'purchase'")
    then = bought.select((F.col("event_id") - 1).alias("event_id"), F.col("user_id").alias("dst"))
    one_way = bought.select("event_id", F.col("user_id").alias("src")).join(then, "event_id").select("src", "dst")
    links = one_way.unionByName(one_way.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return models.temporal_scores(days, links, network()).select("node", F.round("score", 6).alias("score"))


#: Events as labelled pixels of their users' pictures.
_GARMENT = {"purchase": "Dress", "view": "Hat", "click": "Bag", "error": "Face"}


@query(
    f"""WITH l AS (SELECT user_id AS image, event_id % 97 AS y, (event_id // 97) % 89 AS x, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _GARMENT.items())} ELSE 'Background' END AS label FROM events WHERE user_id IS NOT NULL),
    n AS (SELECT image, count(*) AS n FROM l GROUP BY 1), a AS (SELECT image, label, count(*) / any_value(n) AS area, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM l JOIN n USING (image) GROUP BY 1, 2)
    SELECT image, label, round(area, 8) AS area, x0, y0, x1, y1, row_number() OVER (PARTITION BY image ORDER BY area DESC, label)::INTEGER AS place FROM a WHERE label IN ('Dress', 'Hat', 'Bag') AND area >= 0.02"""
)
def region_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in _GARMENT.items()), F.lit("Background"))
    pixels = table(spark, sf_dir, "events").filter("user_id IS NOT NULL").select(F.col("user_id").alias("image"), (F.col("event_id") % 97).alias("y"), F.expr("event_id DIV 97 % 89").alias("x"), label.alias("label"))
    return perception.regions(pixels).select("image", "label", F.round("area", 8).alias("area"), "x0", "y0", "x1", "y1", "place")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan, clean, gate, dedup, window and count by source."""
    raw = documents(spark, sf_dir)
    kept = ingest.clean_documents(raw.select("ord", "doc_id", "source", "text"))
    windows = kept.select("source", F.explode(X.word_windows(F.col("text"))))
    return ingest.run_stats(raw.select("source"), kept.select("source"), windows.select("source"))
