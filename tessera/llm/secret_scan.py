"""Secrets in texts, told apart by who owns them across the corpus.

Each text is scanned for base spans (assignments, access keys, long hex runs) and for further candidates: opaque
tokens of many characters that no base span covers. The values of all are hashed, and the corpus-wide frequency of a
hash is counted in distinct repositories and distinct owners. A value that few owners hold is a live-looking
credential; one that many share is a copied example. Further candidates are reported only if they look live; base
spans always are.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_text, materialise

#: The base patterns and their least lengths, in the order in which ties at one start are listed.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so the least length can stand in the pattern
KINDS = ("assign", "access", "hex", "opaque")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

OPAQUE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Bits of entropy for each character from which a token that mixes letters and digits looks opaque.
OPAQUE_BITS = 3.0
#: A value that more owners hold is a copied example.
LIVE_OWNERS = 2


def entropy(token: str) -> float:
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values())


def candidates(text: str) -> list[tuple[int, int, str, str]]:
    """(start, kind as an index, end, value) of base spans and opaque tokens, by start, then kind."""
    found = [(m.start(), 0, m.end(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    base, at, reach = sorted((a, e) for a, _, e, _ in found), 0, 0
    for m in OPAQUE.finditer(text):  # both lists are in order: each base span is passed once
        while at < len(base) and base[at][0] < m.end():
            reach, at = max(reach, base[at][1]), at + 1
        t = m[0]
        if reach <= m.start() and any(c.isdigit() for c in t) and any(c.isalpha() for c in t) and entropy(t) >= OPAQUE_BITS:
            found.append((m.start(), 3, m.end(), t))
    return sorted(found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str = "source") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end, value_hash, n_repos, n_owners, live>>), one row per input row.

    Starts and ends are code points, ends exclusive. Null and empty texts have no spans; long texts are scanned
    whole. n_repos and n_owners count the distinct repositories and the distinct owners that hold a value; where a table
    tells only one of the two, as ``documents`` does by its source, both columns name it and the counts are equal. A
    null repository or owner counts as one more. Repeated rows are separate rows that share repository and
    owner, so they make no value look copied. An empty table gives an empty result; columns that are not named are
    not read. Only candidate rows take part in the count: (hash, repository) and (hash, owner) are made distinct
    before they meet, so a value copied into a third of all rows is counted from partial sums.
    """
    kinds = dict(docs.dtypes)

    def make():
        def f(columns, texts):
            rows = [[{"kind": KINDS[k], "start": a, "end": e, "value_hash": hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest()[:32]} for a, k, e, v in candidates(t)] for t in texts]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value_hash", pa.string())]))
            return {"doc_id": columns[0], "repo": columns[2], "owner": columns[3], "found": pa.array(rows, kind)}

        return f

    schema = f"doc_id {kinds[id_col]}, repo string, owner string, found array<struct<kind string, start long, end long, value_hash string>>"
    rows = docs.select(id_col, text_col, F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"))
    found = materialise(map_text(rows, make, schema, 1).withColumn("row", F.monotonically_increasing_id()), "secrets")
    one = found.filter(F.size("found") > 0).select("row", "repo", "owner", F.inline("found"))
    held = [one.select("value_hash", F.coalesce(c, F.lit("")).alias(c), F.col(c).isNull().alias("none")).distinct().groupBy("value_hash").agg(F.count("*").alias(n)) for c, n in (("repo", "n_repos"), ("owner", "n_owners"))]
    frequency = held[0].join(held[1], "value_hash")
    span = F.struct("start", F.when(F.col("kind") == "assign", 0).when(F.col("kind") == "access", 1).when(F.col("kind") == "hex", 2).otherwise(3).alias("at"), "kind", "end", "value_hash", "n_repos", "n_owners", (F.col("n_owners") <= LIVE_OWNERS).alias("live"))
    judged = one.join(frequency, "value_hash").filter((F.col("kind") != "opaque") | (F.col("n_owners") <= LIVE_OWNERS))
    by_row = judged.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("sorted"))
    out = found.select("row", "doc_id").join(by_row, "row", "left")
    spans = F.transform("sorted", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value_hash"].alias("value_hash"), s["n_repos"].alias("n_repos"), s["n_owners"].alias("n_owners"), s["live"].alias("live")))
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,value_hash:string,n_repos:bigint,n_owners:bigint,live:boolean>>")
    return out.select("doc_id", F.coalesce(spans, empty).alias("spans"))
