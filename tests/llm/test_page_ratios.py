"""Path scores decide on every page; marks only weigh."""

import math
import random
import re
import time

import pyarrow.parquet as pq
import pytest

from tessera.llm import html_extract

LONG = "Some long prose, with commas, and more of it. It goes on for a while, does it not? "


def test_an_unmarked_article_teaser_does_not_replace_the_text():
    page = f"<body><div id=text><h2>Title</h2><p>{LONG * 4}</p><p>Second part. {LONG * 3}</p></div><div><article><a href=/x>Read next</a></article></div></body>"
    text = html_extract.main_text(page)
    assert "Second part." in text and LONG.strip() in text and "Read next" not in text


def test_a_mark_around_the_whole_page_decides_nothing():
    page = f"<body><div class='has-sidebar'><div><h1>Title</h1><p>{LONG * 4}</p></div><div class=sidebar><p>Popular now</p></div></div></body>"
    text = html_extract.main_text(page)
    assert "Title" in text and LONG.strip() in text and "Popular" not in text


def test_short_blocks_inside_main_are_kept_and_comments_are_not():
    paragraphs = f"<p>{LONG * 4}</p><p>{LONG * 3}</p><p>{LONG * 3}</p><p>{LONG * 3}</p>"
    page = f"<main><h1>Title</h1>{paragraphs}<ul class=steps><li>cut<li>fold<li>sew</ul><ul class=user-remarks><li>me too<li>nice</ul></main>"
    text = html_extract.main_text(page)
    assert LONG.strip() in text and "fold" in text and "nice" not in text


def layouts():
    """(page, the article's blocks): articles with lists, tables, captions and titles among chrome, in three frames."""
    rng = random.Random(6)
    chrome = "<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><div class=cookie-banner>We use cookies. <button>OK</button></div>"
    related = "<ul><li><a href=/1>Read this next</a><li><a href=/2>And then this one</a><li><a href=/3>More</a></ul>"
    for n in (2, 3, 8, 20):
        for items in (1, 2, 4, 16):
            for frame in ("<article>%s</article>", "<div id=c><div>%s</div></div>", "<main><section>%s</section></main>"):
                prose = [LONG * rng.randint(2, 5) + f"Part {i}." for i in range(n)]
                steps = [f"Step {i}" for i in range(items)]
                cells = [f"{i} cm" for i in range(items)]
                inner = "<header><h1>A title here</h1></header>" if "article" in frame else "<h1>A title here</h1>"
                inner += "".join(f"<p>{p}</p>" for p in prose[: n // 2]) + "<ul>" + "".join(f"<li>{x}</li>" for x in steps) + "</ul>"
                inner += "<figure><img src=x><figcaption>A caption</figcaption></figure><table>" + "".join(f"<tr><td>{x}</td></tr>" for x in cells) + "</table>"
                inner += "<p>So says <a href=/q>the whole text of this link, which is long</a> too.</p>" + "".join(f"<p>{p}</p>" for p in prose[n // 2 :]) + related
                inner += "<section class=comments><p>first!</p><p>I do not agree with any of this, sorry.</p></section><aside>Popular now</aside>"
                truth = ["A title here", *prose[: n // 2], *steps, "A caption", *cells, "So says the whole text of this link, which is long too.", *prose[n // 2 :]]
                yield f"<body><header>Site name</header>{chrome}{frame % inner}<footer>All rights reserved</footer></body>", " ".join(" ".join(truth).split())


def test_articles_are_whole_whatever_they_hold():
    wrong = total = 0
    for page, truth in layouts():
        got = html_extract.main_text(page)
        total += len(truth)
        if got != truth:
            words, have = truth.split(), got.split()
            wrong += sum(len(w) + 1 for w in set(words) ^ set(have)) + abs(len(truth) - len(got))
    assert wrong <= 0.02 * total, (wrong, total)


def slow_scores(found):
    """The fused ratios by their definition: sums of each path, a Gaussian mean over neighbours, block by block."""

    def of(b):
        return b[0], b[3], b[4]

    text, marks, free = [], [], []
    for b in found:
        own = [c for c in found if of(c) == of(b)]
        text.append(sum(len(c[1]) for c in own) / len(own))
        marks.append(sum(len(html_extract.PUNCTUATION.findall(c[1])) for c in own) / len(own))
        free.append(1 - sum(min(c[2], len(c[1])) for c in own) / sum(len(c[1]) for c in own))

    def mean(x, i):
        near = [(math.exp(-((i - j) ** 2) / (2 * html_extract.SIGMA**2)), x[j]) for j in range(len(x)) if abs(i - j) <= 3 * html_extract.SIGMA]
        return sum(w * v for w, v in near) / sum(w for w, _ in near)

    return [mean(text, i) * (1 + mean(marks, i)) * free[i] for i in range(len(found))]


def pages():
    return pq.read_table("/root/testdata/sf0.001/pages.parquet")["html"].to_pylist()


def test_ratios_against_their_definition():
    rng = random.Random(4)
    tags = ["<div>", "</div>", "<p>", "</p>", "<b>", "</b>", "<a href=x>", "</a>", "words, and. ", "more! ", "<li>", "<ul>", "</ul>", "<article>", "</article>", "<h2>", "</h2>"]
    made = ["".join(rng.choice(tags) for _ in range(60)) for _ in range(200)]
    for page in [p for p in pages()[:40] if p] + made:
        found = html_extract.blocks(page)[0]
        if found:
            assert html_extract.scores(found).tolist() == pytest.approx(slow_scores(found), rel=1e-9, abs=1e-9)


def test_without_the_marks_the_ratios_find_the_article():
    wrong = total = 0
    for page in filter(None, pages()):
        plain = re.sub(r"(?i)(</?)(?:article|main)\b", r"\1div", page)
        want, got = html_extract.main_text(page), html_extract.main_text(plain)
        total += len(want)
        wrong += abs(len(want) - len(got)) + (want not in got and got not in want) * len(want)
    assert wrong <= 0.01 * total


@pytest.mark.parametrize("name", ["side-by-side", "social-policy", "article-comments-enabled"])
def test_names_that_hold_a_chrome_word_are_no_chrome(name):
    page = f"<article><h1>Head</h1><p>{LONG * 2}</p><div class='{name}' id='{name}'><p>Kept here. {LONG}</p></div></article>"
    assert "Kept here." in html_extract.main_text(page)
    assert "x=1" in html_extract.main_text(f"<article><p>{LONG}</p><p>{LONG} so <math><mi>x=1</mi></math></p></article>")


@pytest.mark.parametrize("part", ["<a ", '<a b="', "<div>x", "<a \"'<b '", "<p>x", "</x>", "<i><b></i>"])
def test_broken_pages_take_linear_time(part):
    took = []
    for n in (50_000, 400_000):
        began = time.process_time()
        html_extract.main_text(part * (n // len(part)))
        took.append(time.process_time() - began)
    assert took[1] < 24 * max(took[0], 0.02)
