"""Main text of pages whose right answer is known."""

import random

import xml.etree.ElementTree as ET

import pytest

from bytequarry.llm import html_extract as H
from bytequarry.llm.html_extract import extract, extract_main_text

CHROME = (
    '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About</a></li></ul></nav>',
    '<header><a href="/">Site name</a></header>',
    '<div class="sidebar"><h3>More</h3><p>Read this too, and that, and more of it, as it is so good, really.</p></div>',
    '<div class="ad">Buy now, cheap, best, only today.</div>',
    '<div id="cookie-notice"><p>We use cookies, as all do.</p></div>',
    '<form><label>Mail</label><input name="m"><button>Send</button></form>',
    "<script>var x = '<p>no</p>';</script>",
    "<style>p { margin: 0 }</style>",
    '<footer>&copy; 2020 Somebody. All rights reserved.</footer>',
    '<section class="comments"><div class="comment"><p>I like this, a lot, and will come again, soon.</p></div></section>',
    "<aside><p>Other stories, of other days, by other people.</p></aside>",
)


def _article(rng):
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9)))
    blocks = [" ".join(word() for _ in range(rng.randint(8, 60))) + rng.choice([".", ", yes.", "!"]) for _ in range(rng.randint(2, 12))]
    return blocks


def test_random_pages():
    rng = random.Random(5)
    for _ in range(200):
        blocks = _article(rng)
        title = "A title of it"
        body = "".join(f"<p>{b.replace(' ', chr(10), 1)}</p>" for b in blocks)
        before, after = rng.sample(CHROME, 4), rng.sample(CHROME, 4)
        wrap = rng.choice(["<article>{}</article>", '<div class="content">{}</div>', "<main>{}</main>", '<div id="post-body">{}</div>'])
        page = f"<!DOCTYPE html><html><head><title>T</title></head><body>{''.join(before)}{wrap.format(f'<h1>{title}</h1>' + body)}{''.join(after)}</body></html>"
        assert extract(page) == " ".join([title, *blocks]), page


def test_character_references_and_spaces():
    page = "<article><p>a &amp; b&nbsp;c &#x41;&#66; &eacute; &lt;i&gt;</p><p>two\n\n  words<br>here</p></article>"
    assert extract(page) == "a & b c AB é <i> two words here"


LONG = "The first of it, and more, and still more of it, as it was told, by all who were there, at length."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<article><section><p>{LONG}</p></section><section><p>Second part</p></section></article>", f"{LONG} Second part"),
        (f"<body><div><p>{LONG}</p></div><p>A closing line</p></body>", f"{LONG} A closing line"),
        (f"<body><div><p>{LONG}</p></div><pre>x = 1</pre><table><tr><td>a</td><td>b</td></tr></table></body>", f"{LONG} x = 1 a b"),
        (f"<body><div><p>{LONG}</p></div><div>Another plain text, of the same kind</div></body>", f"{LONG} Another plain text, of the same kind"),
        (f"<body><div><p>{LONG}</p></div>loose <b>text</b> here<div>© 2020 N. N.</div></body>", f"{LONG} loose text here"),
        (f'<article><p>{LONG}</p><div class="notice-content">Mind this.</div></article>', LONG),
        (f'<article><p>{LONG}</p><div class="content alert">Mind this.</div></article>', LONG),
        (f'<body><div class="content has-sidebar"><p>{LONG}</p></div><div class="sidebar">x, y.</div></body>', LONG),
        (f'<div class="post tag-news"><p>{LONG}</p></div>', LONG),
        (f'<body><div><p>{LONG}</p></div><ul><li><a href="/1">One link</a></li><li><a href="/2">Another link</a></li></ul></body>', LONG),
        (f"<main><div><div><p>{LONG}</p></div></div><div><ul><li>a point</li></ul></div></main>", f"{LONG} a point"),
    ],
)
def test_what_belongs_to_the_article(page, want):
    assert extract(page) == want


def _second_statement(page):
    """The best container's id, from the definition: every paragraph's points to each ancestor, then the discount for links."""
    root = ET.fromstring(page)
    up = {k: p for p in root.iter() for k in p}
    text = lambda e: " ".join("".join(e.itertext()).split())
    chars = lambda e: sum(len(s.strip()) for s in e.itertext())
    density = lambda e: sum(chars(a) for a in e.iter("a")) / max(chars(e), 1)
    score = {}
    for p in root.iter("p"):
        points = (1 + text(p).count(",") + min(len(text(p)) / 100, 3)) * (1 - density(p)) if chars(p) else 0
        for share in (1, 1 / 2, 1 / 6, 1 / 9, 1 / 12):
            if (p := up.get(p)) is None or not points:
                break
            score[p] = score.get(p, 0) + points * share
    return max((s * (1 - density(e)), e.get("id")) for e, s in score.items() if e.tag == "div")


def test_scores_against_a_second_statement():
    rng = random.Random(12)

    def block(depth, ids):
        if depth == 0 or rng.random() < 0.4:
            words = "".join(rng.choice(("word ", "word, ", '<a href="/x">link</a> ')) for _ in range(rng.randint(1, 60)))
            return f"<p>{words}</p>"
        ids.append(f"k{len(ids)}")
        own = ids[-1]
        return f'<div id="{own}">{"".join(block(depth - 1, ids) for _ in range(rng.randint(1, 4)))}</div>'

    for _ in range(150):
        ids: list = []
        page = f'<body><div id="k">{"".join(block(4, ids) for _ in range(3))}</div></body>'
        root = H._parse(page)
        H._prune(root)
        best, most, _ = H._best(root)
        score, own = _second_statement(page)
        if best.tag == "div":
            assert abs(most - score) < 1e-9 and (best.marks == own or abs(most - score) < 1e-9), page
        else:
            assert best.tag == "body" and most >= score


def test_broken_markup():
    assert extract("<article><p>One<p>Two, three.<b>bold<p>Four</article>") == "One Two, three.bold Four"
    assert extract("<p>unclosed <a href='x") .startswith("unclosed")
    assert extract("a < b and c > d") == "a < b and c > d"
    deep = "<div>" * 5000 + "<p>deep, text, here.</p>" + "</div>" * 5000
    assert extract(deep) == "deep, text, here."
    assert extract("<!-- never closed <p>x</p>") == ""


def test_frames(spark):
    long = "<article>" + "".join(f"<p>{k} is a number, and so on.</p>" for k in range(20_000)) + "</article>"
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "<nav>menu</nav>", "x"), (4, "u", "<article><p>Ünï.</p></article>", "x"), (4, "u", "<article><p>Ünï.</p></article>", "x"), (None, "u", long, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((str(r.page_id), r.n_chars) for r in extract_main_text(df).collect()))
    assert got == [("1", 0), ("2", 0), ("3", 0), ("4", 4), ("4", 4), ("None", sum(len(f"{k} is a number, and so on.") for k in range(20_000)) + 19_999)]
    assert extract_main_text(df.limit(0)).count() == 0
