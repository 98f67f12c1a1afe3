"""Secrets, page text, language, top-k and decontamination against brute force."""

import hashlib
import html
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontam, html_extract, langid, queries, secret_scan, topk
from tessera.llm.common import table

SF = "/root/testdata/sf0.01"


# -- secrets


def slow_base(text):
    """The base patterns as stated, each with a scan of its own."""
    out = []
    key = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    at, assign = 0, re.compile(key + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    while m := assign.search(text, at):
        if len(m[1]) >= 6:
            out.append((m.start(), 0, m.end()))
        at = m.end()
    for kind, pattern, least in ((1, "AKIA[A-Z0-9]+", 20), (2, "[0-9a-f]+", 24)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(out)


SECRETS = [
    'token = "abc123def"', "password:abc12", "password:abc123", "secret = token: abcdefgh", "api_key='x'", "APIKEY==abcdefgh", "AKIA" + "A" * 16, "AKIA" + "A" * 15,
    "AKIAAKIA" + "B" * 12, "deadbeef" * 3, "deadbeef" * 2 + "abcdef0", "x" * 9 + "0123456789abcdef01234567z", "ſecret=abcdefg", "toKen=abcdefg", "passwd \t= abcdefg", "token=token=abcdefg",
]


def test_base_spans_are_the_stated_ones():
    rng = random.Random(1)
    parts = ["token", "PassWord", " ", "=", ":", '"', "'", "abc", "012345", "AKIA", "ABCDEF012345678901", "0123456789abcdef", "é", "\n", "api_", "key", "secret"]
    for text in SECRETS + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(4000)]:
        got = [(a, k, e) for a, k, e, _ in secret_scan.candidates(text) if k < 3]
        assert got == slow_base(text), text


def test_secret_owners_and_defined_cases(spark):
    shared, mine = "Zx91kQ8bLm20pTr5Vw73aaaa", "Qw7hY2jK9dF4sG6zX1cV8bN3"
    rows = [(i, f"see {shared} here", f"s{i}") for i in range(4)] + [(10, f"é {mine}!", "s1"), (11, None, "s1"), (12, "", None), (None, 'token = "abc123def"', None), (13, 'token = "abc123def"', "s2"), (13, 'token = "abc123def"', "s2"), (14, " ".join(SECRETS), "s2"), (15, "y" * 200_000 + " deadbeefdeadbeefdeadbeef", "s4")]
    docs = spark.createDataFrame([(a, b, c, "k") for a, b, c in rows], "doc_id long, text string, source string, kind string")
    got = {(r["doc_id"], tuple((s["kind"], s["start"], s["end"], s["n_owners"], s["live"]) for s in r["spans"])) for r in secret_scan.scan(docs).collect()}
    assert (0, ()) in got and (11, ()) in got and (12, ()) in got
    assert (10, (("opaque", 2, 26, 1, True),)) in got
    assert (13, (("assign", 0, 18, 2, True),)) in got and (None, (("assign", 0, 18, 2, True),)) in got
    assert secret_scan.scan(docs).count() == len(rows)
    assert secret_scan.scan(docs.limit(0)).count() == 0


def test_secret_query_on_a_table(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, SF, "documents").collect()}
    got = {r["doc_id"]: r for r in queries.op3_secret_scan(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        base = slow_base(t)
        spans = ",".join(f"{secret_scan.KINDS[k]}:{a}:{e}" for a, k, e in base)
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s[1] == n for s in base) for n in range(3)]
        assert got[i]["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
        assert set(spans.split(",") if spans else []) <= set(got[i]["spans"].split(","))


def test_secrets_of_a_long_text_in_linear_time():
    part = "password=abc123456 " + "a1b2c3d4e5f6g7h8i9j0k1l2 "
    took = []
    for n in (500, 8000):
        began = time.process_time()
        assert len(secret_scan.candidates(part * n)) == 2 * n
        took.append(time.process_time() - began)
    assert took[1] < 64 * max(took[0], 0.005)


def test_overlap_with_base_spans_against_every_pair():
    rng = random.Random(21)
    for _ in range(300):
        text = "".join(rng.choice(["token=", "AKIA", "QRSTUVWXYZ234567", "0123456789abcdef", "a1B2c3D4", " ", "/", "x"]) for _ in range(25))
        found = secret_scan.candidates(text)
        base = [(a, e) for a, k, e, _ in found if k < 3]
        want = [(m.start(), m.end()) for m in secret_scan.OPAQUE.finditer(text) if any(map(str.isdigit, m[0])) and any(map(str.isalpha, m[0])) and secret_scan.entropy(m[0]) >= secret_scan.OPAQUE_BITS and not any(a < m.end() and m.start() < e for a, e in base)]
        assert [(a, e) for a, k, e, _ in found if k == 3] == want


def test_repositories_and_owners_are_counted_apart(spark):
    secret = "password=hunter2hunter2"
    rows = [(i, secret, repo, owner) for i, (repo, owner) in enumerate([("r1", "a"), ("r1", "b"), ("r1", "b"), ("r2", "b"), (None, "c"), (None, None)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, repo string, who string")
    span = secret_scan.scan(docs, repo_col="repo", owner_col="who").first()["spans"][0]
    assert (span["n_repos"], span["n_owners"], span["live"]) == (3, 4, False)


# -- pages


def test_pages_against_their_marked_article(spark):
    pages = {r["page_id"]: r["html"] for r in table(spark, SF, "pages").collect()}
    got = {r["page_id"]: r for r in queries.op4_html_extract(spark, SF).collect()}
    assert got.keys() == pages.keys()
    for i, page in pages.items():
        article = re.search(r"<article>(.*)</article>", page, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", article)).split())
        assert got[i]["text"] == want and got[i]["n_chars"] == len(want)


LONG = "Some long prose, with commas, and more of it. It goes on for a while, does it not? "
PAGES = {
    "without an article": (f"<body><div class=nav><a href=/>Home</a> <a href=/b>About us</a></div><div id=main><h2>Title</h2><p>{LONG * 3}<p>Second &amp; {LONG * 2}</div><div class='comments'><p>{LONG}</div><ul><li><a>x</a><li><a>y</a></ul></body>", ["Title", "Second &"], ["Home", "About", "x y"]),
    "parts inside the article": (f"<article><header><a>Menu</a></header><h1>Head</h1><p>{LONG}</p><div class='ad-box'>Buy now</div><form>Mail <input></form><aside>See also</aside><section id=comments><p>{LONG}First!</p></section></article><footer>(c)</footer>", ["Head", LONG.strip()], ["Menu", "Buy", "Mail", "See also", "First!", "(c)"]),
    "notices and hidden parts": (f"<main><p>{LONG}</p><div role=alert>Alert</div><div hidden>Hid</div><p style='display: none'>None</p></main><div class='cookie-notice'>We use cookies</div><aside>Side</aside>", [LONG.strip()], ["Alert", "Hid", "None", "cookies", "Side"]),
    "broken markup": (f"<p>{LONG}<b>bold <i>both</b> rest</i><br>next<!-- gone --><script>var a='<p>x</p>'</script><p>1 < 2 &lt; 3 &#233;&nbsp;end {LONG}<style>p{{}}", ["bold both rest next", "1 < 2 < 3 é end"], ["gone", "var", "p{"]),
}


@pytest.mark.parametrize("name", PAGES)
def test_layouts(name):
    page, has, lacks = PAGES[name]
    text = html_extract.main_text(page)
    assert all(x in text for x in has), text
    assert not any(x in text for x in lacks), text


def test_page_cases(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article>a  b\n c</article>"), (3, "u", "<nav>only</nav>"), (3, "u", "<nav>only</nav>"), (4, "u", "<article>" + "<div>" * 3000 + "deep"), (5, "u", "<" * 2000), (6, "u", "<article><p>" + "word " * 60_000)]
    pages = spark.createDataFrame([(a, b, c, "t") for a, b, c in rows], "page_id long, url string, html string, text string")
    got = [(r["page_id"], r["text"]) for r in html_extract.extract_main_text(pages).collect()]
    assert len(got) == len(rows) and (None, "a b c") in got and (1, "") in got and (3, "") in got and (4, "deep") in got
    assert dict(got)[6] == ("word " * 60_000).strip()
    assert html_extract.extract_main_text(pages.limit(0)).count() == 0


# -- language


def test_suffix_automaton_holds_all_substrings():
    rng = random.Random(2)
    for _ in range(30):
        s = [rng.randrange(3) for _ in range(rng.randint(0, 30))]
        t = langid.suffix_automaton(s, 3)
        have = {()} | {tuple(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1)}
        for _ in range(200):
            probe, state = [rng.randrange(3) for _ in range(rng.randint(0, 6))], 0
            for c in probe:
                state = t[state, c] if state >= 0 else -1
            assert (state >= 0) == (tuple(probe) in have)


def slow_phrases(text, sample, known):
    """Greedy longest matches of a block in a sample, one by one; letters of no sample are none."""
    n, i = 0, 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in sample:
            j += 1
        n += text[i] in known
        i = max(i + 1, j - 1)
    return n


def test_phrases_against_substring_search():
    rng = random.Random(3)
    samples = {"x": "".join(rng.choice("abc ") for _ in range(200)), "y": "".join(rng.choice("cdé ") for _ in range(150))}
    parser = langid.CrossParser(samples)
    folded = {k: " " + " ".join(v.split()) + (" " if v[-1] == " " else "") for k, v in samples.items()}
    texts = ["".join(rng.choice("abcdéz .,7") for _ in range(rng.choice((0, 1, 5, 80, 700)))) for _ in range(60)]
    counts, _, letters = parser.phrases(texts)
    for t, got, n in zip(texts, counts, letters):
        words = "".join(c if c.isalpha() else " " for c in t)
        flat = " " + " ".join(words.split()) + (" " if words and words[-1] == " " else "") if words.strip() else ""
        assert n == sum(map(str.isalpha, t))
        some = bool(set(flat) & set("".join(folded.values())) - {" "})
        assert got.tolist() == [some * slow_phrases(flat, folded[k], set("".join(folded.values()))) for k in ("x", "y")], t
    # the language of least phrases, each weighed by the size of what it was found in
    known = len(set("".join(folded.values())) - {" "})
    weight = {k: math.log2(len(v) + known + 1) for k, v in folded.items()}
    langs, scores = parser.predict(texts)
    for t, lang, score, got, n in zip(texts, langs, scores, counts, letters):
        cost = sorted((c * weight[k], k) for c, k in zip(got.tolist(), ("x", "y")))
        assert lang == (cost[0][1] if n else "und")
        assert abs(score - (1 - cost[0][0] / cost[1][0] if n and cost[1][0] else 0)) < 1e-9


def test_a_small_sample_is_no_disadvantage_and_long_texts_are_whole():
    rng = random.Random(12)
    word = {k: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(300)] for k, letters in (("a", "abcdefg"), ("b", "bcdefgh"))}
    prose = lambda k, n: " ".join(rng.choice(word[k]) for _ in range(n))
    parser = langid.CrossParser({"a": prose("a", 4000), "b": prose("b", 500)})
    texts = [prose(k, 60) for k in "ab" * 20]
    assert sum(x == k for x, k in zip(parser.predict(texts)[0], "ab" * 20)) >= 39
    long = [prose("a", 3000), "", prose("b", 30), prose("b", 2000)]
    together, alone = parser.phrases(long)[0], [parser.phrases([t])[0][0] for t in long]
    assert together.tolist() == [x.tolist() for x in alone]


def test_null_and_shared_ids_are_sampled_fairly(spark):
    rows = [(None, "the cat and the dog sat there", "en")] * 3000 + [(7, f"der hund und die katze {i}", "de") for i in range(300)] + [(i, "le chat et le chien dorment", "fr") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.langs == ["de", "en", "fr"]
    assert all(r["lang_pred"] == r["lang"] for r in langid.identify(docs, model, keep=("lang",)).distinct().collect())


def test_labels_without_letters_are_no_languages(spark):
    docs = spark.createDataFrame([(1, "the cat", "en"), (2, "123", "xx"), (3, "a cat", "en")], "doc_id long, text string, lang string")
    assert langid.fit(docs).langs == ["en"]


def test_language_query_is_accurate_and_honest(spark):
    got = {r["doc_id"]: r for r in queries.op8_langid(spark, SF).collect()}
    docs = table(spark, SF, "documents").collect()
    assert len(got) == len(docs)
    assert all(got[d["doc_id"]]["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2) for d in docs)
    held = [d for d in docs if got[d["doc_id"]]["held_out"]]
    assert sum(got[d["doc_id"]]["lang_pred"] == d["lang"] for d in held) >= 0.96 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_cases(spark):
    rows = [(1, "the cat and the dog sat there", "en", 0.0), (2, "der hund und die katze sind da", "de", 0.0), (3, None, "en", 0.0), (4, "", None, 0.0), (5, "123 !!", "de", 0.0), (6, "日本語", None, 0.0), (None, "the the the", None, 0.0), (7, "die katze " * 20_000, None, 0.0), (7, "die katze " * 20_000, None, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.identify(docs, langid.fit(docs)).collect()]
    assert sorted(got, key=repr) == sorted([(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (6, "de"), (None, "en"), (7, "de"), (7, "de")], key=repr)
    empty = docs.limit(0)
    assert langid.identify(empty, langid.fit(empty)).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.identify(docs, langid.fit(unlabelled)).collect()} == {"und"}


# -- top-k


def test_top_k_with_ties_repeats_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES_AT_ONCE", 7)
    monkeypatch.setattr(topk, "SAMPLE", 20)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4) / 8], 1) for i in range(300)]
    rows += [(400, None, 1), (500, [0.1, None, 0.2, 0.3], 1), (600, [0.1, float("nan"), 0.2, 0.3], 1), (700, [float("inf"), 0.0, 0.0, 0.0], 1), (None, [1.0, 1.0, 1.0, 1.0], 1), (800, [0.5], 1), (900, [], 1), (1000, rows[0][1], 1), (1000, rows[0][1], 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = [tuple(r) for r in topk.exact_top_k(vectors, F.col("vec_id") % 50 == 0, k=5).collect()]
    fine = [(i, np.floor(1024 * np.array(v, dtype=np.float32).astype(float)).astype(int)) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for n, (q, x) in enumerate(fine):
        if q % 50 == 0:
            scores = sorted(((-int(sum(a * b for a, b in zip(x, y))), i) for m, (i, y) in enumerate(fine) if m != n))[:5]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    assert sorted(got) == sorted(want)
    assert topk.exact_top_k(vectors.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.exact_top_k(vectors, F.col("vec_id") < 0).count() == 0
    assert len(topk.exact_top_k(vectors.filter("vec_id < 3"), F.col("vec_id") == 0).collect()) == 2


def test_blocks_are_skipped_and_nothing_is_lost():
    rng = np.random.default_rng(5)
    vecs = np.concatenate([rng.integers(900, 1000, (512, 8)), rng.integers(-5, 5, (4 * 512, 8))])
    ids = np.arange(len(vecs))
    best = topk.Best(3, 4)
    q = rng.integers(1, 50, (3, 8))
    scored = topk.search_blocks(vecs, ids, ids, q, np.array([-1, -1, -1]), np.full(3, topk.LOWEST + 1), best)
    assert scored == 3 * 512
    s = q @ vecs.T
    assert (np.sort(s, axis=1)[:, ::-1][:, :4] == best.scores).all()
    big = np.array([[2**40, 2**40]]), np.array([[2**21, 1]])
    assert topk.product(*big)[0, 0] == 2**61 + 2**40


# -- decontamination


def substring_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_bit_parallel_distance():
    rng = random.Random(8)
    for _ in range(400):
        item = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 80)))
        want = substring_distance(item, text)
        if want < len(item):
            d, end = decontam.Pattern(item).search(text, len(item))
            assert d == want and substring_distance(item, text[:end]) == want


def test_matches_against_brute_force(spark):
    rng = random.Random(11)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate((3, 8, 14, 20, 30))] + [(90, "Tiny"), (91, None), (None, "alpha beta"), (92, "!!"), (93, "alpha beta gamma delta eps zeta eta theta")]
    docs = []
    for n in range(80):
        item = list(decontam.fold(rng.choice([t for _, t in items[:5]])))
        for _ in range(rng.randrange(0, 12)):
            p = rng.randrange(len(item))
            item[p : p + rng.randrange(2)] = rng.choice(["", "x", "q "])
        docs.append((n, "Start, " + " ".join(rng.choice(words) for _ in range(10)) + ". " + "".join(item).upper() + "\n  end"))
    docs += [(100, None), (101, ""), (None, items[1][1]), (102, "tiny"), (103, "tinyx untiny"), (104, "a TINY! b"), (105, "word " * 40_000 + items[4][1]), (106, docs[0][1]), (106, docs[0][1])]
    d = spark.createDataFrame([(a, b, 1, "h") for a, b in docs], "doc_id long, text string, item_id int, hits string")
    t = spark.createDataFrame([(a, b, "e") for a, b in items], "item_id long, text string, end string")
    for at_once in (10**6, 60):  # one pass, and one for almost every item
        got = [(r["doc_id"], sorted((h["item_id"], h["distance"]) for h in r["hits"])) for r in decontam.contaminated(d, t, at_once=at_once).collect()]
        want = []
        for doc, text in docs:
            folded, hits = decontam.fold(text or ""), []
            for i, item in items:
                item = decontam.fold(item or "")
                if i is None or not item or not folded:
                    continue
                if len(folded) < 3000 and (x := substring_distance(item, folded)) <= int(decontam.BUDGET * len(item)) or item in folded:
                    hits.append((i, 0 if item in folded else x))
            want.append((doc, sorted(hits)))
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert decontam.contaminated(d.limit(0), t).count() == 0
    assert all(not r["hits"] for r in decontam.contaminated(d, t.limit(0)).collect())


def test_leaks_of_a_table(spark):
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    want = {(d["doc_id"], i) for d in table(spark, SF, "documents").collect() for i, t in items if t in d["text"]}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op10_decontam(spark, SF).collect()}
    assert want <= got and len(got) <= len(want) + 3


def test_scores_out_of_range_have_a_named_error():
    big = np.array([[2**40]], dtype=np.int64)
    with pytest.raises(topk.ScoreRange):
        topk.product(big, big)
    assert topk.product(np.array([[2**30]]), np.array([[2**31 - 1]])).tolist() == [[2**30 * (2**31 - 1)]]
