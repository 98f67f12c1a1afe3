"""Near-duplicates: lines by edits, documents by shingle sets, components."""

import random
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import line_dedup as L
from tessera.llm import linking, minhash
from tessera.llm.common import located, table

SF = "/root/testdata/sf0.01"


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def mutated(rng, s, edits, alphabet="abc"):
    s = list(s)
    for _ in range(edits):
        p = rng.randrange(len(s) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            s.insert(p, rng.choice(alphabet))
        elif s and kind == 1:
            s.pop(min(p, len(s) - 1))
        elif s:
            s[min(p, len(s) - 1)] = rng.choice(alphabet)
    return "".join(s)


def test_banded_distance_against_levenshtein():
    rng = random.Random(1)
    for _ in range(3000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(3, 40)))
        b = mutated(rng, a, rng.randint(0, 5))
        tau = rng.choice((1, 2, 3))
        d = levenshtein(a, b)
        assert L.within(a, b, tau) == (d <= tau)
        assert d > tau or L.may_agree(a, b, tau)


@pytest.mark.parametrize("dense", [L.DENSE, 0])
def test_packed_keys_come_out_as_they_went_in(monkeypatch, dense):
    monkeypatch.setattr(L, "DENSE", dense)
    rng = np.random.default_rng(4)
    key = np.sort(rng.integers(0, 1 << 48, 3000).astype(np.uint64))
    columns = [rng.integers(-(1 << 62), 1 << 62, 3000), rng.integers(0, 1 << 16, 3000).astype(np.uint16), rng.integers(0, 1 << 16, 3000).astype(np.uint16)]
    cuts = np.searchsorted(key, np.array([1 << 46, 1 << 47], dtype=np.uint64))
    blobs = list(L.packed(key, *columns, cuts))
    assert all((x == y).all() for x, y in zip(L.unpacked([b for _, b in blobs]), [key, *columns]))
    assert {p for p, _ in blobs} == {0, 1, 2} and all(((k >> np.uint64(46)) == 0).all() for p, b in blobs if p == 0 for k in L.unpacked([b])[:1])


def test_pairs_measured_side_by_side_against_levenshtein():
    rng = random.Random(3)
    pairs, taus = [], []
    for _ in range(2000):
        a = "".join(rng.choice("abcdé") for _ in range(rng.choice((0, 1, 5, 20, 40, 70))))
        pairs.append((a, mutated(rng, a, rng.randint(0, 9))))
        taus.append(rng.choice((0, 1, 2, 5, 9, 31, 40)))
    assert L.within_all(pairs, taus) == [levenshtein(a, b) <= t for (a, b), t in zip(pairs, taus)]
    assert L.within_all([], []) == []


FLAT = L.Budget(share=0, slack=0, tau=2, least=24)


def brute_links(lines, budget):
    """All linked pairs: every pair whose lengths and letters allow it is measured."""
    lines = sorted(lines, key=len)
    sizes = np.array([len(t) for t in lines])
    counts = np.array([L.letters(t) for t in lines]).reshape(len(lines), 64)
    links = []
    for i, a in enumerate(lines):
        most = int(budget.of(len(a)))
        end = np.searchsorted(sizes, len(a) + most, "right")
        off = counts[i + 1 : end] - counts[i]
        for j in np.nonzero(np.maximum(off.clip(0).sum(1), -off.clip(None, 0).sum(1)) <= most)[0]:
            if L.within(a, lines[i + 1 + j], most):
                links.append((a, lines[i + 1 + j]))
    return links


def brute_lines(rows, budget=L.BUDGET):
    """(doc_id, line_no, class_doc, class_line, kept, number of the row) of (doc_id, text) rows in their order."""
    places = defaultdict(list)
    for r, (doc, text) in enumerate(rows):
        for n, line in enumerate((text or "").split("\n")):
            if line.strip(L.WHITE):
                places[line.strip(L.WHITE)].append((doc is None, doc or 0, r, n))
    root = components(places, brute_links(places, budget))
    first = {}
    for t, where in places.items():
        first[root[t]] = min(first.get(root[t], where[0]), *where)
    name = lambda p: None if p[0] else p[1]
    return sorted(((name(p), p[3], name(first[root[t]]), first[root[t]][3], p == first[root[t]], p[2]) for t, where in places.items() for p in where), key=repr)


@pytest.mark.parametrize(("budget", "sf"), [(L.BUDGET, SF), (FLAT, "/root/testdata/sf0.001")])
def test_lines_against_brute_force_on_a_table(spark, budget, sf):
    docs = table(spark, sf, "documents")
    got = sorted(map(tuple, L.line_classes(docs, budget).collect()), key=repr)
    want = brute_lines([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], budget)
    assert got == sorted((r[:5] for r in want), key=repr)


def test_lines_edge_cases(spark, budget=L.BUDGET):
    base = "the quick brown fox jumps over the lazy dog number "
    rng = random.Random(3)
    rows = [(1, None, "x"), (2, "", "x"), (3, "  \n\t\n", "x"), (None, base, "x"), (4, base + "1\nshort\n" + base + "1", "x"), (5, base + "22\nshort", "x"), (6, "short.\n" + base.upper(), "x"), (7, "é" * 30 + "\n" + "é" * 29, "x"), (8, "z" * 100_000, "x"), (9, "z" * 99_990, "x"), (None, base + "new", "x"), (None, base + "1\nno id here", "x")]
    rows += [(10 + i, "\n".join([base + str(i), mutated(rng, base * 2, i % 6, "xyz")]), "x") for i in range(120)]
    rows += [rows[5], rows[5], (5, "another text of the same id", "x")]
    docs = spark.createDataFrame([(a, b, c, 0, 0, "f", 1) for a, b, c in rows], "doc_id long, text string, line string, kept int, component int, file string, row int").coalesce(1)
    got = sorted(map(tuple, L.line_classes(docs, budget).collect()), key=repr)
    want = brute_lines([r[:2] for r in rows], budget)
    assert got == sorted((r[:5] for r in want), key=repr)
    gone = {(r[5], r[1]) for r in want if not r[4]}
    left = L.drop_repeated_lines(docs, budget)
    texts = [(d, t and "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone)) for i, (d, t, _) in enumerate(rows)]
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr) == sorted(texts, key=repr)
    assert left.columns == docs.columns
    assert L.line_classes(docs.limit(0), budget).count() == 0


def test_rows_of_files_are_told_apart(spark, tmp_path):
    rows = [(1, "a line of text that comes twice"), (1, "a line of text that comes twice"), (None, "a line of text that comes twice")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "rows"))
    docs = spark.read.parquet(str(tmp_path / "rows"))
    got = located(docs.filter("text is not null")).select("__file", "__row").distinct().count()
    assert got == 3 and "_metadata" in located(docs)._jdf.queryExecution().analyzed().toString()
    twice = docs.unionByName(docs)
    assert located(twice).select("__file", "__row").distinct().count() == 6
    left = sorted((r["text"], r["doc_id"]) for r in L.drop_repeated_lines(docs).collect() if r["text"])
    assert left == [(rows[0][1], 1)]


def test_a_hot_segment_of_unrelated_lines(spark, monkeypatch):
    """One passage in thousands of lines that differ otherwise, and chains of near copies among them."""
    monkeypatch.setattr(L, "HOT", 8)
    monkeypatch.setattr(L, "FULL", 0)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9)))
    passage = " ".join(word() for _ in range(20))
    lines = [f"{' '.join(word() for _ in range(6))} {passage} {' '.join(word() for _ in range(rng.randint(6, 9)))}" for _ in range(3000)]
    for i in range(0, 300, 3):
        lines[i + 1] = mutated(rng, lines[i], 3, "xyz")
        lines[i + 2] = mutated(rng, lines[i + 1], 4, "xyz")
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["class_doc"], r["kept"]) for r in L.line_classes(docs).collect()}
    want = {r[0]: (r[2], r[4]) for r in brute_lines(list(enumerate(lines)))}
    assert got == want and sum(not k for _, k in got.values()) > 150


def test_keys_of_long_lines_do_not_depend_on_pieces(monkeypatch):
    rng = random.Random(2)
    lines = ["".join(rng.choice("abcdef ") for _ in range(n)) for n in (30, 500, 4000)]

    def keys():
        key, line, tag, _ = L.line_keys(lines, L.BUDGET)
        marked = tag >= L.INDEXED
        return {*zip(key.tolist(), line.tolist())}, {*zip(key[marked].tolist(), line[marked].tolist())}

    whole, marked = keys()
    monkeypatch.setattr(L, "PIECE_CHARS", 16 * 64)
    assert keys() == (whole, marked) and len(marked) < len(whole)


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, i) for i in range(5001, 5100)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in linking.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a != b]
    assert got == components({x for e in real for x in e}, real)
    assert linking.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, k):
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute_documents(rows, k, threshold):
    sets = [(d, shingles(t, k)) for d, t in rows]
    real = [(d, s) for d, s in sets if s and d is not None]
    links = []
    for i, (a, s) in enumerate(real):
        for b, t in real[:i]:
            both = len(s & t)
            if both and 100 * both >= threshold * (len(s) + len(t) - both):
                links.append((a, b))
    root = components({d for d, _ in sets if d is not None}, links)
    return sorted(((d, len(s), root.get(d), d is None or root[d] == d) for d, s in sets), key=repr)


@pytest.mark.parametrize(("words", "threshold"), [(3, 85), (5, 80)])
def test_documents_against_brute_force(spark, words, threshold):
    rng = random.Random(words)
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice((40, 120, 300)))] for _ in range(4)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "ONE"), (5, "One two"), (6, "one two "), (None, "one two"), (7, "É é"), (8, "é é"), (9, "x " * 30_000)]
    n = 10
    for base in bases:
        for _ in range(70):  # copies with ever more words replaced: chains of links near the threshold
            doc = list(base)
            for _ in range(rng.randrange(1 + len(base) // 12)):
                doc[rng.randrange(len(doc))] = rng.choice(vocabulary)
            rows.append((n, " ".join(doc)))
            n += 1
    rows += [rows[20], rows[20]]
    docs = spark.createDataFrame([(d, t, "c", 1) for d, t in rows], "doc_id long, text string, component_id string, n int")
    got = sorted(map(tuple, minhash.near_duplicates(docs, words, threshold).collect()), key=repr)
    assert got == brute_documents(rows, words, threshold)
    assert minhash.near_duplicates(docs.limit(0), words, threshold).count() == 0


def test_blocks_count_and_join_as_sets_do():
    rng = np.random.default_rng(2)
    a = [np.unique(rng.integers(0, 90, rng.integers(1, 60)).astype(np.uint64)) for _ in range(30)]
    b = [np.unique(rng.integers(0, 90, rng.integers(1, 60)).astype(np.uint64)) for _ in range(20)]
    got = minhash.common_counts(a, b)
    assert all(got[i, j] == len(np.intersect1d(x, y)) for i, x in enumerate(a) for j, y in enumerate(b))
    _, candidates, _ = minhash.block_counter(3, 50)()
    block = linking.Joining(list(range(30)), list(range(30)), a, list(range(100, 120)), list(range(100, 120)), b)
    links = [link for i, j in candidates(a, b) if (link := block.join(i, j))]
    full = [(i, 100 + j) for i, x in enumerate(a) for j, y in enumerate(b) if got[i, j] * 100 >= 50 * len(np.union1d(x, y))]
    nodes = {*range(30), *range(100, 120)}
    assert components(nodes, links) == components(nodes, full) and len(links) < len(nodes)


def test_estimates_follow_the_similarity():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    for share in (0.5, 0.8, 0.9):
        both = int(1000 * share)
        errors = []
        for _ in range(40):
            x = rng.permutation(pool)
            a, b = x[:1000], np.concatenate([x[:both], x[1000 : 2000 - both]])
            true = both / (2000 - both)
            got = minhash.estimate(minhash.registers(a)[None], minhash.registers(b)[None], np.array([1000]), np.array([1000]))[0]
            errors.append(got - true)
        assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < minhash.MARGIN


def test_texts_of_documents_that_met_are_found_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(minhash, "FILTER_BITS", 256)
    ids = [-(1 << 63), -257, -1, 0, 1, 63, 64, 65, 255, 256, 1000, (1 << 63) - 1]
    texts = spark.createDataFrame([(i, f"text {i}") for i in ids] + [(None, "no id"), (64, "text 64")], "node long, text string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large to be sent to every task
    try:
        for wanted in (ids[::2], ids[1::3], []):
            found = minhash.texts_for(texts, spark.createDataFrame([(i,) for i in wanted * 2], "node long"))
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
            bits = {i % 256 for i in wanted}
            assert sorted(r["node"] for r in found.collect()) == sorted(i for i in [*ids, 64] if i % 256 in bits)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_letters_allow_as_sums_of_surplus_do(monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(L, "COMPARED", 1000)
    a, b = (rng.integers(0, 9, (60, 32)).astype(np.int16) for _ in range(2))
    b[:20] = a[:20] + rng.integers(0, 2, (20, 32))
    p, q = (x.ravel() for x in np.mgrid[0:60, 0:60])
    most = rng.integers(0, 60, len(p))
    off = (a[p] - b[q]).astype(int)
    want = np.maximum(np.where(off > 0, off, 0).sum(1), np.where(off < 0, -off, 0).sum(1)) <= most
    assert 0 < want.sum() < len(p) and L.letters_allow(a, b, p, q, most).tolist() == want.tolist()


def test_blocks_and_pairs_keep_the_number_of_partitions(spark):
    """Few bytes are much work here: adaptive execution must not put all blocks, or all pairs, into one task."""
    groups = spark.range(64).selectExpr("id % 8 AS hub", "0 AS salt", "id AS node", "id AS component", "true AS outside", "8L AS n_outside", "8L AS n_members")
    dealt = linking.dealt_blocks(groups, spark.range(64).selectExpr("id AS node", "'x' AS text"), "outside", "text")
    texts = spark.range(64).selectExpr("id AS node", "concat('the line of number ', id) AS text")
    near = L.agreeing(spark.range(32).selectExpr("id AS a", "id + 32 AS b"), texts, L.sketched(texts), L.BUDGET)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert n > 1 and [df.rdd.getNumPartitions() for df in (dealt, near)] == [n, n]
