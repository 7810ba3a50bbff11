import random

import pytest

from veilgrove.llm import html_text as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>no</p>";</script></head>
<body class="has-sidebar nav-open"><header class="site-header"><h1>Site</h1><nav><a href="/">Home</a></nav></header>
<div class="cookie-notice">We use cookies</div><div id="menu"><ul><li><a href="#">One</a></ul></div>
<div class="layout with-sidebar"><article class="post post-12"><header><h1>The &eacute;t&eacute; {n}</h1><div class="share">Share this</div></header>
<p>First <b>bold</b> paragraph,\n with   space &amp; a <a href="x">link</a>.<p>Second&nbsp;one<br>goes on &#8212; &lt;here&gt;.
<div class="ad">Buy now</div><form><label>Mail</label><input></form><ul><li>item one<li>item two</ul><!-- no <p>comment</p> -->
<table><tr><td>a<td>b</table><blockquote>Quoted a < b words</blockquote></article>
<div class="sidebar"><p>Related things</p></div><section id="comments"><p>Reader said</p></section></div>
<footer>&copy; me</footer></body></html>"""
TEXT = "The été {n}\nFirst bold paragraph, with space & a link.\nSecond one goes on — <here>.\nitem one\nitem two\na\nb\nQuoted a < b words"


def test_one_page():
    assert H.extract(PAGE.format(n=1), None) == TEXT.format(n=1)


def test_consensus_rescues_a_page(spark):
    """A page whose own best container is wrong is read by its host's path."""
    odd = "<html><body><div class='x1'><article class='post'><p>Short.</p></article></div><div class='list'><p>" + "Some other long running text that is not the article. " * 20 + "</p></div></body></html>"
    usual = "<html><body><div class='x2'><article class='post'><p>" + "Long article text here. " * 30 + "</p></article></div><div class='list'><p>tiny</p></div></body></html>"
    rows = [(i, f"https://A.example.org:80/p/{i}", usual) for i in range(5)] + [(9, "https://a.example.org/odd", odd), (10, "https://b.example.org/odd", odd)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS _host", "'q' AS text")
    got = {r.page_id: r for r in H.main_text(df.drop("_host")).collect()}
    assert got[9].text == "Short." and got[9].n_chars == 6 and got[9].url.endswith("odd")
    assert got[10].text.startswith("Some other") or got[10].text == "Short."
    assert all(got[i].text == ("Long article text here. " * 30).strip() for i in range(5))


def test_the_votes_are_the_sum_of_all_pages(spark):
    pages = [(i, f"http://h{i % 3}.example/", PAGE.format(n=i) if i % 2 else f"<div class='c{i}'><p>words {i}</p></div>") for i in range(30)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    want = {}
    for i, u, h in pages:
        for path, score in H.votes(h).items():
            want.setdefault(u.split("/")[2], {}).setdefault(path, []).append(score)
    best = {host: min(((-round(sum(v), 4), p) for p, v in by.items()))[1] for host, by in want.items()}
    assert {r._host: r._path for r in H.host_paths(df).collect()} == best


def test_odd_pages(spark):
    odd = [None, "", "plain words", "<p>", "</p></div>", "<", "<p>a<p>b", "<script>x", "<!-- x", "a<br>b", "<body>x</body><p>y", "&amp&am;&#0;", "<p title='a>b'>c</p>", "<p title=\"x>d", "<td>1<td>2", "<div>" * 3000 + "deep", "x" * 300_000]
    df = spark.createDataFrame([(i, None if i % 2 else "::no url", h) for i, h in enumerate(odd)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.main_text(df).collect()}
    assert len(got) == len(odd)
    assert got[0] == got[1] == got[3] == got[7] == got[8] == ""
    assert got[2] == "plain words" and got[6] == "a\nb" and got[9] == "a b" and got[12] == "c" and got[15] == "deep" and len(got[16]) == 300_000
    assert H.main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_any_markup_is_read(seed):
    rng = random.Random(seed)
    bits = ["<p>", "</p>", "<div class='ad'>", "</div>", "<b>", "</b>", "text ", "&amp;", "<ul><li>", "<td>", "<", ">", "'", '"', "<!--", "-->", "<a href=x>", "</a>", "</body>", "<br/>", "<script>", "</script>"]
    page = "".join(rng.choice(bits) for _ in range(300))
    text = H.extract(page, None)
    assert text == "\n".join(" ".join(x.split()) for x in text.split("\n"))


@pytest.mark.parametrize("name", ["share-post", "sidebar-content", "newsletter-body", "post-nav", "entry-footer", "ad-container", "comments-content", "cookie-notice-page"])
def test_parts_in_an_article_stay_out_by_any_word(name):
    page = f"<body><article class='post'><p>Real text of the article.</p><div class='{name}'><p>Not the article.</p></div><p>More of it.</p></article></body>"
    assert H.extract(page, None) == "Real text of the article.\nMore of it."


@pytest.mark.parametrize("attr", ["class='content has-sidebar'", "class='layout with-sidebar'", "class='no-ads'", "class='sidebar-right' id='main-content'", "class='page'"])
def test_content_stays(attr):
    assert H.extract(f"<body><div {attr}><p>Real text of the page.</p></div></body>", None) == "Real text of the page."


def made_page(rng, n):
    """A page, and the text of its article as the maker knows it."""
    words = lambda a, b: " ".join(rng.choice("river stone bird wind moon tree road song night day".split()) for _ in range(rng.randint(a, b)))
    entity = lambda t: t.replace(" bird ", rng.choice([" b&iuml;rd ", " &#98;ird ", " bird&nbsp;"]), 1)
    body, want = "", []

    def block(tag, text):
        nonlocal body
        shown = entity(text)
        want.append(" ".join(__import__("html").unescape(shown).split()))
        inner = shown.replace(" moon ", rng.choice([" <b>moon</b> ", " <a href='/m?a=1&b=>'>moon</a> ", "\n\tmoon  "]), 1)
        body += f"<{tag}>{inner}" + (f"</{tag}>" if tag != "p" or rng.random() < 0.6 else "")

    block("h1", words(3, 6))
    for _ in range(rng.randint(3, 9)):
        kind = rng.randrange(7)
        if kind < 4:
            block("p", words(10, 40))
        elif kind == 4:
            body += "<ul>"
            for _ in range(rng.randint(1, 3)):
                block("li", words(3, 8))
            body += "</ul>"
        elif kind == 5:
            body += rng.choice(["<div class='advert-box'><p>Buy " + words(3, 9) + "</p></div>", "<aside>" + words(3, 9) + "</aside>", "<script>if (a<b) { '</p>' }</script>", "<!-- <p>" + words(2, 4) + " -->", "<form><input> " + words(2, 4) + "</form>", "<style>p > a {}</style>"])
        else:
            block("blockquote", words(8, 20))
    around = "".join(f"<li><a href='/{k}'>{words(1, 3)}</a></li>" for k in range(6))
    page = f"<!doctype html><html><head><title>{words(2, 4)}</title></head><body><header class='top'><a href='/'>{words(1, 2)}</a></header><nav><ul>{around}</ul></nav>"
    page += f"<div class='wrap{n}'><div class='column main-text'>{body}</div><div class='rail'><ul>{around}</ul></div><div id='comments'><p>{words(30, 80)}</p></div></div><footer>{words(3, 8)}</footer></body></html>"
    return page, "\n".join(want)


def test_whole_tables_against_the_makers_text(spark):
    rng = random.Random(12)
    made = [made_page(rng, n) for n in range(120)]
    rows = [(n, f"https://h{n % 4}.example/{n}", page) for n, (page, _) in enumerate(made)]
    rows += [(1000 + n, u, p) for n, u, p in rows[:10]]  # repeated rows
    got = {r.page_id: r for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    for n, (_, want) in enumerate(made):
        assert got[n].text == want and got[n].n_chars == len(want)
    assert all(got[1000 + n].text == got[n].text for n in range(10))


def test_the_first_path_in_order_wins_of_equal_votes(spark):
    pages = [(1, "http://h.example/", "<div class='b'><p>same words</p></div>"), (2, "http://h.example/", "<div class='a'><p>same words</p></div>")]
    got = H.host_paths(spark.createDataFrame(pages, "page_id long, url string, html string")).first()
    assert got._path == "html>div.a"


@pytest.mark.parametrize("bit", ["<a href=\"x>word ", "<div><span>x", "<p>x</b></i></li>", "< a <b <c", "<script>", "<a \"b\" c=\"d>x</a>", "<!-- ", "</"])
def test_broken_pages_take_time_in_proportion(bit):
    import time

    def took(n):
        began = time.process_time()
        H.extract(bit * n, None)
        return time.process_time() - began

    took(1000)
    assert took(16_000) < 12 * took(4000) + 0.2
