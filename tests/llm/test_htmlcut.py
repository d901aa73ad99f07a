import itertools
import time

import numpy as np
import pytest

from ledgermill.llm import htmlcut


def brute_cut(score, edges):
    best = None
    for keep in itertools.product([False, True], repeat=len(score)):
        cost = sum(max(s, 0) for s, k in zip(score, keep, strict=True) if not k) + sum(max(-s, 0) for s, k in zip(score, keep, strict=True) if k)
        cost += sum(w for u, v, w in edges if keep[u] != keep[v])
        best = cost if best is None else min(best, cost)
    return best


def test_cut_is_minimal():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        score = rng.normal(0, 2, n).round(2).tolist()
        edges = [(int(u), int(v), float(w)) for u, v, w in zip(rng.integers(0, n, 9), rng.integers(0, n, 9), rng.random(9).round(2), strict=True) if u != v]
        keep = htmlcut.minimum_cut(score, edges)
        cost = sum(max(s, 0) for s, k in zip(score, keep, strict=True) if not k) + sum(max(-s, 0) for s, k in zip(score, keep, strict=True) if k)
        cost += sum(w for u, v, w in edges if keep[u] != keep[v])
        assert cost == pytest.approx(brute_cut(score, edges))


PARA = "Long enough words make this a paragraph that a reader would want, number {}."


@pytest.mark.parametrize(
    "page,want",
    [
        (None, ""),
        ("", ""),
        ("<nav>a</nav>", ""),
        (f"<article><h1>T&amp;&#233;</h1><p><b>{PARA.format(1)}<br><p>{PARA.format(2)}\n x</article><footer>&copy; f</footer>", f"T&é\n\n{PARA.format(1)}\n\n{PARA.format(2)} x"),
        (f"<body><script>var a='</p>';</script><style>p{{}}</style><div class='post'><p>{PARA.format(1)}</p><div class='ad'>Buy</div><p>{PARA.format(2)}</p></div><div id=comments><p>{PARA.format(3)}</p></div>", f"{PARA.format(1)}\n\n{PARA.format(2)}"),
        (f"<main><p>{PARA.format(1)}</p><form>Name <input></form><aside>{PARA.format(2)}</aside><p>{PARA.format(3)}", f"{PARA.format(1)}\n\n{PARA.format(3)}"),
        (f"<div><p>{PARA.format(1)}</p><p>{PARA.format(2)}</p></div><ul><li><a href=x>Home</a></li><li><a href=y>More</a></li></ul>", f"{PARA.format(1)}\n\n{PARA.format(2)}"),
        ("<!-- open " * 3 + "x", ""),
        (f"<body class='has-sidebar single-post with-comments'><div><p>{PARA.format(1)}</p></div><div class=sidebar>{PARA.format(2)}</div></body>", PARA.format(1)),
        (f"<div class='post text-tags'><p>{PARA.format(1)}</p><p>{PARA.format(2)}</p></div>", f"{PARA.format(1)}\n\n{PARA.format(2)}"),
        (f"<div class='with-sidebar'><article><p>{PARA.format(1)}</p></article><aside>{PARA.format(2)}</aside></div>", PARA.format(1)),
        (f"<div class=post><p>{PARA.format(1)}</p></div><div class=comments>" + f"<article><p>{PARA.format(3)}</p></article>" * 9 + "</div>", PARA.format(1)),
        (f"<article><p class=x\">{PARA.format(1)}<p data-x='class=\"ad\"'>{PARA.format(2)}<p title='a>b'>{PARA.format(3)}</article>", "\n\n".join(map(PARA.format, (1, 2, 3)))),
        (f'<article><p>{PARA.format(1)}<p title="it>{PARA.format(2)}</article>', f"{PARA.format(1)}\n\n{PARA.format(2)}"),
        ("<article><p>Hi</p></article>", "Hi"),
    ],
)
def test_main_text(spark, page, want):
    assert htmlcut.main_text(page or "") == want


def test_rows_are_whole(spark):
    long = "<article>" + "<p>word word word word word word</p>" * 4000 + "</article>"
    rows = [(1, "u", long, 0), (1, "u", long, 0), (None, None, None, 0), (2, "v", "", 0), (3, "w", "<a <b>> </p></div>", 0)]
    got = htmlcut.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert [r.n_chars for r in got if r.page_id == 1] == [4000 * 29 + 3999 * 2] * 2
    assert htmlcut.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_deep_and_stray_tags_take_linear_time():
    body = f"<p>{PARA.format(1)}"
    for page in ("<div>" * 100_000 + body, "<div class=post>" * 100_000 + body, "<b><div>" * 50_000 + "</b>" * 50_000 + body, "</section>" * 100_000 + body, "<p>" + "<i>" * 100_000 + "</p>" + body):
        began = time.process_time()
        assert htmlcut.main_text(page) == PARA.format(1)
        assert time.process_time() - began < 10


def test_the_flow_changes_labels_of_the_pages(spark):
    """Short paragraphs of an article, and long text of a notice, are labelled against their own cost."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("html").collect()
    rescued = removed = blocks_n = 0
    for (page,) in pages:
        blocks, hints = htmlcut.blocks_of(page)
        for b, keep in zip(blocks, htmlcut.label(blocks, hints), strict=True):
            blocks_n += 1
            rescued += keep and htmlcut.cost(b) < 0
            removed += not keep and htmlcut.cost(b) > 0
    assert blocks_n > 1000 and rescued > 0 and removed > 0


def test_edges_alone_decide_without_hints():
    """A short line between paragraphs of one parent is content; the same line in a menu is not."""
    page = f"<div><p>{PARA.format(1)}</p><p>Ha ha.</p><p>{PARA.format(2)}</p></div><ul><li><a href=a>Ha ha.</a></li><li><a href=b>One</a></li></ul>"
    assert htmlcut.main_text(page) == f"{PARA.format(1)}\n\nHa ha.\n\n{PARA.format(2)}"


LONG = "These words go on for a while, since an article's paragraph has a thing to say and says it at some length, with one clause after the other, until number {} has been told in full."


def against_hints(page):
    """Texts labelled against what the nearest telling element says of them."""
    blocks, hints = htmlcut.blocks_of(page)
    return [b.text for b, keep in zip(blocks, htmlcut.label(blocks, hints), strict=True) if b.hint >= 0 and hints[b.hint].kind in (1, -1) and keep != (hints[b.hint].kind > 0)]


@pytest.mark.parametrize("opening", ['<article><h1>Title</h1><div class="share-enabled">', '<main><h1>Title</h1><section id="legal">', '<div class=post><h1>Title</h1><div class="side">'])
def test_text_outweighs_a_weak_name_on_its_wrapper(opening):
    texts = [LONG.format(k) for k in range(5)]
    page = opening + "".join(f"<p>{t}</p>" for t in texts)
    assert htmlcut.main_text(page) == "\n\n".join(["Title", *texts])
    assert against_hints(page) == texts


@pytest.mark.parametrize(
    "part",
    [
        '<div class="share"><a href=x>Tweet</a> <a href=y>Mail</a></div>', "<div class=legal>All rights are reserved.</div>", '<div class="comments"><p>' + LONG.format(8) + "</p></div>",
        "<ul><li><a href=a>Home</a></li><li><a href=b>About us</a></li><li><a href=c>Contact</a></li></ul>", "<aside class=share><p>" + LONG.format(9) + "</p></aside>",
    ],
)
def test_what_is_no_text_of_the_article_goes_within_it(part):
    texts = [LONG.format(k) for k in range(3)]
    page = f"<div class=post><h1>Title</h1><p>{texts[0]}</p><p>{texts[1]}</p>{part}<p>{texts[2]}</p></div>"
    assert htmlcut.main_text(page) == "\n\n".join(["Title", *texts])
    if "<ul>" in part:
        assert against_hints(page) == ["Home", "About us", "Contact"]


def test_lists_and_short_lines_of_an_article_stay():
    page = f"<article><h2>Needed</h2><ul><li>Milk</li><li>Two eggs</li><li>A <a href=x>pan</a> of iron</li></ul><p>{PARA.format(1)}</p><p>Ha.</p></article>"
    assert htmlcut.main_text(page) == f"Needed\n\nMilk\n\nTwo eggs\n\nA pan of iron\n\n{PARA.format(1)}\n\nHa."
