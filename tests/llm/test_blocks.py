import os
import time

import pyarrow.parquet as pq
import pytest
from hypothesis import given
from hypothesis import strategies as st

from registrum.llm.blocks import SHARE, THRESHOLD, WINDOW, extracted, humps, main_text

LONG = "A long paragraph of the article that goes on and on with many words so that windows pass the threshold easily. "


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("   ", ""),
        ("plain &amp; short", "plain & short"),
        ("<article><h1>T &lt;1&gt;</h1><p><b>a  b<br>c\n<p>d &amp;amp; &am</article>", "T <1>\na b c\nd &amp; &am"),
        ("<title>x</title><nav><ul><li><a href=/>m</a></li></ul></nav><div class='ad'>buy</div><article>one<p>two</p>three</article><footer>f</footer>", "one\ntwo\nthree"),
        ("<article><header>h</header>a<aside>s</aside><p>b <a href='?x>y'>link</a></p><div id=comments><p>me too</p></div><form>f<input></form><p>c</article><p>after", "a\nb link\nc"),
        ("<script>var t='</p>';</script><style>p{}</style><!-- <article>no</article> --><main>yes<noscript>n</noscript></main>", "yes"),
        (f"<div>home</div><div><p>{LONG}</p><p>ok</p><p>{LONG}</p></div><div class='sidebar'>{LONG}</div>", f"{LONG.strip()}\nok\n{LONG.strip()}"),
        ("<article>un<closed <p>x</article", "un<closed\nx</article"),
        ("<article><div class=ad>x</div><p>1 < 2 & 3</p></ARTICLE>", "1 < 2 & 3"),
        ("<article><p>A</p><div class='share-price'>..</div><p class='banner-year'>B</p><section class='social-policy'>..</section></article>", "A\n..\nB\n.."),
        ("<article><p>A</p><div class='socialShare top-bar'>s</div><div id=reader-comments>c</div></article>", "A"),
        (f"<body><div>home</div><h1>T</h1><p>by X</p><p>{LONG}</p><p>end</p><div>c 2024</div></body>", f"T\nby X\n{LONG.strip()}\nend"),
        (f"<div class=a><p>{LONG}</p></div><div>m</div><div>m</div><div>m</div><div>m</div><div class=b><p>t</p><p>{LONG}</p></div>", f"{LONG.strip()}\nt\n{LONG.strip()}"),
        (f"<div><p>{LONG}</p><ul><li><a>x</a><li><a>y</a><li><a>z</a></ul><p>{LONG}</p><p><a>one link</a></p></div>", f"{LONG.strip()}\nx\ny\nz\n{LONG.strip()}\none link"),  # further reading inside the text
        (f"<div><p>{LONG}</p><p>{LONG}</p><ul><li><a>x</a><li><a>y</a><li><a>z</a></ul></div>", f"{LONG.strip()}\n{LONG.strip()}"),
        (f"<form action=/page.aspx><input type=hidden><div class=top><input name=q><button>Go</button></div><div id=c><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div></form>", f"T\n{LONG.strip()}\n{LONG.strip()}"),
        (f"<form><article><p>{LONG}</p></article><input></form>", LONG.strip()),
        (f"<article><p>A text.</p><form>{LONG * 2}<input><input><input><textarea></textarea></form></article>", "A text."),
        (f"<div><div class='content-header'><h1>Title</h1></div><p>{LONG}</p></div>", f"Title\n{LONG.strip()}"),
        (f"<header><h1>Site</h1></header><article><header><h1>Title</h1><p>by x</p></header><p>{LONG}</p></article>", f"Title\n{LONG.strip()}"),
        (f"<article><nav><h1>Menu</h1></nav><p>{LONG}</p></article>", LONG.strip()),
        (f"<main>Skip to text</main><div><p>{LONG * 3}</p></div>", (LONG * 3).strip()),
        ("<div class=widget><p>only text here</p></div>", "only text here"),
        ("<article></article><div class=ad>buy</div>", ""),
        ("<article><p class='notice'>cookie</p><p>kept</p><p>Ansh. é\xa0ü</p></article>", "kept\nAnsh. é ü"),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


def test_rows(spark):
    schema = "page_id long, url string, html string, text int"
    pages = spark.createDataFrame([(1, "u", None, 0), (2, None, "<main>x</main>", 0), (2, None, "<main>x</main>", 0), (3, "v", "<p>" + "z" * 200_000, 0)], schema)
    got = [tuple(r) for r in extracted(pages).collect()]
    assert got[:3] == [(1, "u", "", 0), (2, None, "x", 1), (2, None, "x", 1)] and got[3][3] == 200_000
    assert extracted(pages.limit(0)).collect() == []


def plain_humps(weight, window, threshold):
    """The definition, window by window: lines of windows at the threshold, in runs, without the light runs."""
    sums = [sum(weight[i : i + window]) for i in range(len(weight))]
    threshold = min(threshold, max(sums, default=0))
    hit = {j for i, s in enumerate(sums) if s >= threshold > 0 for j in range(i, min(i + window, len(weight)))}
    starts = [j for j in sorted(hit) if j - 1 not in hit]
    runs = [(j, next(e for e in range(j, len(weight) + 1) if e not in hit)) for j in starts]
    most = max((sum(weight[a:b]) for a, b in runs), default=0)
    return [(a, b) for a, b in runs if sum(weight[a:b]) >= SHARE * most]


@given(st.lists(st.integers(0, 120), max_size=30), st.integers(1, 4), st.integers(1, 150))
def test_humps_follow_the_definition(weight, window, threshold):
    assert humps(weight, window, threshold) == plain_humps(weight, window, threshold)


def plain_text(tree, window=WINDOW, threshold=THRESHOLD):
    """Main text of a tree [(name, text or children)] of div and p by walking it anew for every question."""
    lines = []

    def walk(nodes, path):
        for name, inside in nodes:
            own = (*path, (name, id(inside), len(lines)))
            if isinstance(inside, str):
                lines.append((inside, own))
            else:
                walk(inside, own)

    walk(tree, ())
    weight = [len(text) for text, _ in lines]
    kept, done = set(), 0
    for a, b in plain_humps(weight, window, threshold):
        heavy = min(threshold, max(weight[a:b]))
        strong = [i for i in range(a, b) if weight[i] >= heavy]
        boxes = [[e for e in lines[i][1] if e[0] == "div"] for i in strong]
        shared = [e for e in boxes[0] if all(e in x for x in boxes)]
        if shared:
            own = {i for i, (_, path) in enumerate(lines) if shared[-1] in path}
        else:
            direct = lambda i: not any(e[0] == "div" for e in lines[i][1])
            own, i = set(range(strong[0], strong[-1] + 1)), strong[0]
            while i > 0 and direct(i - 1):
                i -= 1
                own.add(i)
            i = strong[-1]
            while i + 1 < len(lines) and direct(i + 1):
                i += 1
                own.add(i)
        if strong[-1] >= done:
            kept |= own
            done = max(done, max(own) + 1)
    return "\n".join(lines[i][0] for i in sorted(kept))


LEAVES = st.tuples(st.just("p"), st.sampled_from(["home", "by an author", "x" * 60, "y" * 90, "z" * 200]))
TREES = st.recursive(st.lists(LEAVES, min_size=1, max_size=6), lambda inner: st.lists(st.one_of(LEAVES, st.tuples(st.just("div"), inner)), min_size=1, max_size=6), max_leaves=12)


@given(TREES)
def test_unmarked_pages_against_brute_force(tree):
    write = lambda nodes: "".join(f"<{n}>{x if isinstance(x, str) else write(x)}</{n}>" for n, x in nodes)
    assert main_text(write(tree)) == plain_text(tree)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the tables aren't here")
def test_marks_only_weigh():
    """Without its article element, a page gives the same text; the driver's pages all have one."""
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column(0).to_pylist()
    for page in pages:
        want = main_text(page)
        assert want
        for a, b in (("<div>", "</div>"), ("", "")):
            assert main_text(page.replace("<article>", a).replace("</article>", b)) == want


@pytest.mark.parametrize("page", ["<div>" * 200_000 + "</x>" * 200_000, "<i>" + "<div>" * 150_000 + "</i>" * 150_000, "<b>" * 200_000 + "<div></div>" * 100_000, "<a \"'" * 300_000, "<head>" * 300_000, "<ul><li>x" * 150_000, "<!--" * 300_000])
def test_broken_pages_are_read_in_linear_time(page):
    began = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - began < 8


def test_other_columns(spark):
    rows = spark.createDataFrame([(1, "u", "<main>x</main>", "t", 7)], "page_id long, url string, html string, text string, n_chars int")
    assert [tuple(r) for r in extracted(rows).collect()] == [(1, "u", "x", 1)]
