"""Main text of pages."""

import html as entities
import random
import re

import pytest

from custvalue.llm import html as H

LONG = "The cat sat on the mat and it was in the house of the man, which is on the hill by the sea with all of the others."


@pytest.mark.parametrize(
    "page,blocks",
    [
        (None, []),
        ("", []),
        ("<article>", []),
        ("<article><h1>A  title</h1><p>One &amp; two&nbsp;x<br>three</p></article>", ["A title", "One & two x three"]),
        ("<article>one<p>two<div>three</div>four", ["one", "two", "three", "four"]),
        (f"<nav><ul><li><a href=/>Home</a></ul></nav><main><p>Short.</p><p>{LONG}</p></main><footer>&copy; us</footer>", ["Short.", LONG]),
        (f"<header>Site</header><article><header><h1>Title</h1></header><p>{LONG}</p></article>", ["Title", LONG]),
        (f"<article><p>{LONG}</p><aside>More</aside><form>Your mail <input name=x></form><p>End.</p></article>", [LONG, "End."]),
        (f"<article><p>{LONG}</p><section class='user-comments'><p>{LONG}</p></section></article>", [LONG]),
        (f"<div id=cookieNotice><p>{LONG}</p></div><div class=content><p>{LONG}</p></div>", [LONG]),
        (f"<div><p>{LONG}</p><p>Short</p><p>{LONG}</p></div><p>Far away</p><div><a href=x>link</a> <a href=y>link</a></div>", [LONG, "Short", LONG]),
        (f"<div><a href=x>{LONG}</a></div>", []),
        ("<p>alone", []),
        ("<article><script>var t='</p>';</script><style>p{}</style><!-- <p>no</p> --><p>yes</article>", ["yes"]),
        ("<article><p>a < b, 3<4 &lt;i&gt; </p><p title='x>y'>ok</p><p hidden>no</p>", ["a < b, 3<4 <i>", "ok"]),
        ("<article><p>cut off <a hre", ["cut off"]),
        ("<nav><p>menu<article><p>nav was never closed</article>", ["nav was never closed"]),
        ("<article><script>never closed <p>x</p>", []),
    ],
)
def test_pages(page, blocks):
    assert H.extract(page) == blocks


def test_ambiguous_blocks_take_the_label_of_the_nearer_side():
    links = "<div><a href=1>one</a> <a href=2>two</a></div>"
    page = f"<p>{LONG}</p><p>near the text</p><p>middle</p><p>near the links</p>{links}"
    assert H.extract(page) == [LONG, "near the text"]


@pytest.mark.parametrize(
    "page,blocks",
    [
        (f"<h1>Title</h1><article><p>{LONG}</p></article>", ["Title", LONG]),
        (f"<article><p>{LONG}</p></article><div>Short</div><footer>us</footer>", [LONG]),
        (f"<article>Card</article><footer>x</footer><div><p>{LONG}</p><p>Short</p><p>{LONG}</p></div>", ["Card", LONG, "Short", LONG]),
        (f"<article><p>{LONG} Photo © A. Body</p><p>© A. Body</p></article>", [f"{LONG} Photo © A. Body", "© A. Body"]),
        (f"<div><p>{LONG} © A. Body</p><p>© us</p></div>", [f"{LONG} © A. Body"]),
    ],
)
def test_blocks_outside_articles_and_copyright_signs(page, blocks):
    assert H.extract(page) == blocks


POLISH = "Wieczorem wszyscy spotkali się przy ognisku, a starszy pan opowiadał o dawnych czasach, kiedy w lesie żyły jeszcze wilki. " * 2
RUSSIAN = "Вечером все собрались у костра, и старик рассказывал о давних временах, когда в лесу ещё жили волки. " * 3
CHINESE = "傍晚，大家围坐在篝火旁，老人讲起了很久以前的故事，那时森林里还有狼。" * 8
MENU = "<nav><a href=1>one</a></nav>"


@pytest.mark.parametrize("prose", [LONG, LONG + " " + LONG])
@pytest.mark.parametrize(
    "opening", ['<div class="container has-sidebar">', '<article><div class="layout sidebar-right">', '<div class="page no-search">', '<section id="social-history">']
)
def test_one_listed_word_in_a_name_rules_nothing_out(opening, prose):
    assert H.extract(f"{MENU}{opening}<p>{prose}</p><p>{prose}</p>") == [prose, prose]


def test_titles_in_headers_of_entries():
    page = f'<article><div class="entry-header"><h1>Title</h1></div><p>{LONG}</p><div class="cookie-banner">Yes</div></article>'
    assert H.extract(page) == ["Title", LONG]


@pytest.mark.parametrize("name", ["sidebar", "site-footer", "ad-slot", "comment-list", "commentsArea", "newsletter_signup", "related-posts", "menu main"])
def test_listed_names_rule_out_whatever_they_hold(name):
    assert H.extract(f"<div><p>{LONG}</p></div><div class='{name}'><p>{LONG} {LONG}</p></div>") == [LONG]


@pytest.mark.parametrize("prose", [POLISH, RUSSIAN, CHINESE])
def test_prose_of_other_languages(prose):
    prose = prose.strip()
    assert H.extract(f"{MENU}<div><p>{prose}</p><p>{prose}</p></div><footer>{prose}</footer>") == [prose, prose]


def plain_labels(blocks, rules):
    """Both passes by their definition, block by block."""
    first = [H.first_pass(b, rules) for b in blocks]
    if "good" not in first:
        long = lambda b: not b.article and not b.linked and len(b.text) >= rules.long
        first = ["good" if x is None and long(b) else x for x, b in zip(first, blocks)]
    out = []
    for i, own in enumerate(first):
        edge = "good" if blocks[i].article else "bad"
        sides = []
        for way in (range(i - 1, -1, -1), range(i + 1, len(blocks))):
            at = next((j for j in way if first[j]), None)
            if at is None or (edge == "good" and (not blocks[at].article or blocks[at].boilerplate)):
                sides.append((len(blocks), edge))
            else:
                sides.append((abs(at - i), first[at]))
        near = min(sides)[0]
        heard = {label for far, label in sides if far == near}
        out.append(own or (sides[0][1] if sides[0][1] == sides[1][1] else heard.pop() if len(heard) == 1 else edge))
    return out


def test_both_passes_on_random_pages():
    rng = random.Random(8)
    texts = ["x", "short", LONG, LONG * 2, POLISH, "word " * 30, "© us", "no stop here " * 20]
    for _ in range(400):
        parts = []
        for _ in range(rng.randrange(1, 14)):
            text = rng.choice(texts)
            body = rng.choice([text, f"<a href=x>{text}</a>", f"{text} <a href=x>a link to it</a>"])
            parts.append(rng.choice(["<p>{}</p>", "<nav>{}</nav>", "<article><p>{}</p></article>", "<div class=ad>{}</div>"]).format(body))
        page = "".join(parts)
        blocks = list(H.blocks(page))
        want = [b.text for b, x in zip(blocks, plain_labels(blocks, H.Rules())) if x == "good"]
        assert H.extract(page) == want


LINES = ">".join(["<p>markup in a value</p>"] * 600)  # over 10,000 characters


@pytest.mark.parametrize(
    "page,blocks",
    [
        (f"<article><p>one</p><iframe srcdoc='{LINES}'></iframe><p data-x='{LINES}'>two</p></article>", ["one", "two"]),
        (f'<article><p>one</p><img src="{LINES}"><p title = "{LINES}" lang=en>two</p></article>', ["one", "two"]),
        (f"<div data-x='{LINES}' class=advert><p>{LONG}</p></div><p>{LONG}</p>", [LONG]),
        (f"<div data-x='{LINES}' hidden><p>{LONG}</p></div><p>{LONG}</p>", [LONG]),
        (f"<p>{LONG}</p><div data-x='{'x' * 5000}' id=comments><p>{LONG}</p></div>", [LONG]),
        (f"<p>{LONG}</p><section data-x='{'x' * 5000}' style='display: none'><p>{LONG}</p></section>", [LONG]),
        (f"<article><p title=\"never closed>one</p>{'<p>two</p>' * 2000}</article>", ["one"] + ["two"] * 2000),
        (f"<article><p title=it's>one</p>{'<p>two</p>' * 2000}<p>it's</p></article>", ["one"] + ["two"] * 2000 + ["it's"]),
        ("<article>" + '<b x=">" ' * 200_000, []),
        ("<article><p>one</p>" + '<b x=" ' * 200_001 + ">two", ["one", "two"]),
    ],
)
def test_long_tags_are_read_whole(page, blocks):
    assert H.extract(page) == blocks


def test_registered_pages_equal_their_article_elements(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in H.extract_pages(pages).collect()}
    for page in pages.collect():
        article = re.search("<article>(.*?)(</article>|$)", page["html"], re.S)[1]
        lines = re.sub("<[^>]*>", "", re.sub("</?(?:p|h1|br)>", "\0", article)).split("\0")
        want = "\n\n".join(x for x in (" ".join(entities.unescape(line).split()) for line in lines) if x)
        assert got[page["page_id"]]["text"] == want and got[page["page_id"]]["n_chars"] == len(want)


def test_null_repeated_long_and_empty_tables(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    rows = [(1, "u", "<article><p>é x</p>", "clash", 7), (1, "u", "<article><p>é x</p>", "clash", 7), (None, None, None, None, None)]
    rows.append((2, "u", "<article>" + "<p>word</p>" * 50_000 + "<div>" * 100_000, "", 0))
    got = H.extract_pages(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == [(0, 0), (1, 3), (1, 3), (2, 6 * 50_000 - 2)]
    assert H.extract_pages(spark.createDataFrame([], schema)).collect() == []
