import random
import re
import time

import pytest

from tessella.llm import html
from tests.conftest import SMALL

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x}</style></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div><main><article><h1>Head  &amp;\nline</h1>
<p>One <b>bold</b><br>two &lt;x&gt; caf&eacute;<p>Next<ul><li>a<li>b</ul><aside>side</aside><div class="advert">buy</div><script>var a="</p>";</script>
<form><p>sign up</p></form><table><tr><td>c1<td>c2</table><section id="comments"><article class="comment"><p>first!</p></article></section></article></main>
<footer>&copy; me</footer></body></html>"""


def test_article_without_the_rest():
    assert html.main_text(PAGE).split("\n\n") == ["Head & line", "One bold two <x> café", "Next", "a", "b", "c1 c2"]


@pytest.mark.parametrize(("source", "want"), [(None, ""), ("", ""), ("plain  text", "plain text"), ("<article><p>cut <b", "cut"), ("<article><p>a &am", "a &am"), ("<p>x<!-- <p>no</p> -->y", "xy"), ("<article></article>", ""), ("<script>only", ""), ("<p>" * 3000 + "deep", "deep"), ("<div>" * 3000 + "deep", "deep")])
def test_odd_sources(source, want):
    assert html.main_text(source) == want


def page(n, extra=""):
    return f"<html><body><div class=x><p>Welcome to our site</p></div><div class=x><p>Story {n} has its own words</p>{extra}<p>All rights kept</p></div></body></html>"


def texts(spark, pages):
    """Texts by page_id of the htmls of one host."""
    df = spark.createDataFrame([(i, f"https://h.org/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extracted(df).collect()}
    return [got[i] for i in range(len(pages))]


def test_constant_texts_of_a_host_are_template(spark):
    pages = [page(n, "<p>more</p>" if n % 2 else "") for n in range(10)] + [page(99, "<p>own and another line of the same story</p>")]
    got = texts(spark, pages)
    assert got[10] == "Story 99 has its own words\n\nown and another line of the same story"
    assert got[4] == "Story 4 has its own words"
    assert texts(spark, [page(1)] * 20) == [html.main_text(page(1))] * 20  # copies say nothing about a template


def words(chance, n):
    return " ".join("".join(chance.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def test_the_wrapper_finds_the_article_without_names(spark):
    """Menus, adverts and footers vary, and a short article has less text than they; only its host's other pages tell where it is."""
    chance = random.Random(4)
    pages, want = [], []
    for n in range(30):
        body = [words(chance, 3 if n % 5 == 0 else 60) for _ in range(1 if n % 5 == 0 else 4)]
        menu = "".join(f'<div><a href="/{k}">{words(chance, 2)}</a></div>' for k in range(6))
        pages.append(f"<html><body><div><div>{menu}</div></div><div>{words(chance, 8)}</div><div>{''.join(f'<div>{x}</div>' for x in body)}</div><div>{words(chance, 12)}</div></body></html>")
        want.append("\n\n".join(body))
    got = texts(spark, pages)
    assert got == want
    assert sum(html.main_text(p) != w for p, w in zip(pages, want, strict=True)) >= 6  # pages that the wrapper changes


def without_names(source):
    source = source.replace("<br><p>", "</b></p><p>").replace("<br></article>", "</b></p></article>")
    source = re.sub(r"<(/?)(nav|ul|li|article|h1|p|footer)(?=[ >])", r"<\1div", source)
    return re.sub(r'<div class="[^"]*"', "<div", source)


def test_given_pages_give_the_article_with_and_without_names(spark):
    rows = [r for r in spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/pages.parquet").collect() if r.html]
    df = spark.createDataFrame([(r.page_id, r.url, without_names(r.html)) for r in rows], "page_id long, url string, html string")
    named = {r.page_id: r.text for r in html.query(spark, SMALL.replace("0.001", "0.01")).collect()}
    bare = {r.page_id: r.text for r in html.extracted(df).collect()}
    for r in rows:
        article = re.split(r"</?(?:p|h1|b)>|<br>", r.html.split("<article>")[1].split("</article>")[0])
        assert named[r.page_id].replace("\n\n", " ").split() == " ".join(html.html_module.unescape(x) for x in article).split()
    assert sum(bare[k] == named[k] for k in bare) >= 0.98 * len(bare)


def test_two_layouts_of_a_host_and_a_page_of_neither(spark):
    chance = random.Random(6)
    one = [f"<body><div class=top><p>{words(chance, 4)}</p></div><div class=story><p>A{n} {words(chance, 40)}</p><p>{words(chance, 30)}</p></div></body>" for n in range(8)]
    two = [f"<body><div class=top><p>{words(chance, 4)}</p></div><section class=report><div><p>B{n} {words(chance, 40)}</p></div></section></body>" for n in range(8)]
    other = f"<body><table><tr><td>{words(chance, 9)}</table></body>"
    got = texts(spark, [*one, *two, other])
    assert all(g.startswith(f"A{n} ") for n, g in enumerate(got[:8])) and all(g.startswith(f"B{n} ") for n, g in enumerate(got[8:16]))
    assert got[16] == html.main_text(other) != ""


def test_words_of_class_and_id_drop_nothing_within_the_article():
    inside = '<div class="related-work"><p>a</p></div><section id="form">b</section><p class="social">c</p><h2 id="comment">d</h2><section id=discussion>e</section><div id=notice-of-appeal>f</div>'
    assert html.main_text(f"<body><nav>x</nav><article>{inside}</article></body>") == "a\n\nb\n\nc\n\nd\n\ne\n\nf"
    assert html.main_text("<body><main><h1>Title</h1><p>Lead</p><article>Body</article></main></body>") == "Title\n\nLead\n\nBody"
    assert html.main_text('<div class="search-results"><p>x</p></div>') == "x"


def test_deep_and_wide_pages_are_bounded(spark):
    wide = "<body>" + "".join(f"<div class=c{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}><p>t{i}</p></div><ul><li>u{i}</ul>" for i in range(5_000)) + "</body>"
    deep = "<div>" * 3_000 + "deep"
    got = texts(spark, [wide, deep, wide + "<p>q", deep + "er", page(1)])
    assert got[0].count("\n\n") == 9_999 and got[1] == "deep" and got[3] == "deeper" and "Story 1" in got[4]


def test_query_over_tables(spark):
    pages = [(i, f"https://h{i % 2}.org/{i}", page(i)) for i in range(30)] + [(30, None, None), (31, "x", ""), (31, "x", ""), (None, "https://h0.org/q", page(77))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS _host")
    got = html.extracted(df).collect()
    assert len(got) == len(pages)
    assert all(r.n_chars == len(r.text) for r in got)
    assert {r.text for r in got if r.page_id == 3} == {"Story 3 has its own words"}
    assert {r.text for r in got if r.page_id in (30, 31)} == {""}
    assert html.extracted(df.limit(0)).count() == 0


def plain_tag(source, at):
    """End of the tag that begins at ``at`` and its attributes, sign by sign; end None where the page ends in it."""
    i, n, space = at + 1, len(source), " \n\t\r\f\v"
    while i < n and source[i] not in space + "/>":
        i += 1
    found = {}
    while i < n:
        if source[i] == ">":
            return i + 1, found
        if source[i] in space + "/":
            i += 1
            continue
        begin = i
        i += 1
        while i < n and source[i] not in space + "/>=":
            i += 1
        name, value, j = source[begin:i], "", i
        while j < n and source[j] in space:
            j += 1
        if j < n and source[j] == "=":
            j += 1
            while j < n and source[j] in space:
                j += 1
            i = j
            if j < n and source[j] in "\"'":
                end = source.find(source[j], j + 1)
                if end < 0:
                    return None, found
                value, i = source[j + 1 : end], end + 1
            else:
                while i < n and source[i] not in space + ">":
                    i += 1
                value = source[j:i]
        found.setdefault(name.lower(), value)
    return None, found


def test_tags_equal_a_plain_state_machine():
    chance = random.Random(8)
    parts = ["a", "=", '"', "'", " ", "/", ">", "class", "x", "\n", "<", "==", "='", '="', "it's", "id"]
    for _ in range(20_000):
        source = "<p" + chance.choice(["", " ", " "]) + "".join(chance.choice(parts) for _ in range(chance.randrange(12))) + chance.choice(["", ">", "> tail"])
        end, found = plain_tag(source, 0)
        match = html._TAG.match(source)
        assert (match.end() if match.group("end") else None) == end, repr(source)
        if end:
            assert html.attributes(match.group()) == found, repr(source)


def test_stray_quotes_keep_the_text():
    assert html.main_text('<article><p class=a">Lost text one.</p><p class="b">Second one here.</p></article>') == "Lost text one.\n\nSecond one here."
    assert html.main_text("<article><a href=x title=it's>link</a><p>Tail text one. It's gone.</p></article>") == "link\n\nTail text one. It's gone."
    assert html.main_text('<article><p x"y\'>one</p><p a = "b>c" d>two</p></article>') == "one\n\ntwo"


@pytest.mark.parametrize("source", ["<b>" * 100_000 + "</i>" * 100_000, "<i><table>" + "<b>" * 100_000 + "</i>" * 100_000, "<b>" * 100_000 + "<div></div>" * 100_000, "<ul>" + "<b>" * 50_000 + "<li></li>" * 50_000, "<p a" + " " * 300_000 + "b>", "<p " + "a=' " * 100_000 + ">"])
def test_unmatched_tags_take_linear_time(source):
    began = time.process_time()
    html.Page(source)
    assert time.process_time() - began < 3


@pytest.mark.parametrize("count", [2, 3, 4, 30])
def test_headings_that_all_articles_share_stay(spark, count):
    chance = random.Random(count)
    pages, want = [], []
    for _ in range(count):
        blocks = [words(chance, 6), "Introduction", words(chance, 40), "The usual remark", words(chance, 30), "Conclusion", words(chance, 20)]
        kinds = ["h1", "h2", "p", "p", "p", "h2", "p"]
        pages.append("<nav><a href=/>Home</a></nav><article>" + "".join(f"<{k}>{b}</{k}>" for k, b in zip(kinds, blocks, strict=True)) + "</article><footer>me</footer>")
        want.append("\n\n".join(blocks))
    assert texts(spark, pages) == want


def test_adverts_and_notices_of_any_element_go_and_an_articles_own_parts_stay():
    page = "<article><p>One.</p><p class=advert>Buy</p><p>Two <span class=ad>now</span> three.</p><p class='notice'>Note</p><section class=menu><p>Soup, bread</p></section><table class=widget><tr><td>c</table></article>"
    assert html.main_text(page).split("\n\n") == ["One.", "Two three.", "Soup, bread", "c"]


def layout(chance, n, cells):
    """A page without names whose article is short now and then, so that only other pages of its layout tell where it is."""
    body = [words(chance, 3 if n % 4 == 0 else 60) for _ in range(1 if n % 4 == 0 else 4)]
    parts = [f"<ul><li>{words(chance, 8)}</li></ul>", *[f"<div>{x}</div>" for x in body], f"<h4>{words(chance, 4)}</h4><div>{words(chance, 12)}</div>"]
    if cells:
        return "<body><table><tr><td>" + "</td></tr><tr><td>".join([parts[0], f"<section>{''.join(parts[1:-1])}</section>", parts[-1]]) + "</td></tr></table></body>", "\n\n".join(body)
    menu = "".join(f'<div><a href="/{k}">{words(chance, 2)}</a></div>' for k in range(6))
    return f"<body><div><div>{menu}</div></div><div>{words(chance, 8)}</div><div>{''.join(parts[1:-1])}</div><div>{words(chance, 12)}</div></body>", "\n\n".join(body)


def test_a_layout_of_few_of_a_hosts_pages_is_in_its_wrapper(spark):
    chance = random.Random(12)
    made = [layout(chance, n, n >= 400) for n in range(416)]
    got = texts(spark, [p for p, _ in made])
    assert got[:400] == [w for _, w in made[:400]] and got[400:] == [w for _, w in made[400:]]
    assert sum(html.main_text(p) != w for p, w in made[400:]) >= 3  # pages that the wrapper changes


def tree(source):
    return html.Wrapper.of(html._runs(html.Page(source))).packed()


def mixed(chance, kinds, deep=2):
    """Elements of so many kinds in any order and depth."""
    out = ""
    for _ in range(chance.randrange(1, 7)):
        inner = mixed(chance, kinds, deep - 1) if deep and chance.random() < 0.6 else words(chance, 2)
        out += f"<div class=k{''.join(chr(97 + int(d)) for d in str(chance.randrange(kinds)))}>{inner}</div>"
    return out


@pytest.mark.parametrize("kinds", [1, 3, 30, 4_000])
def test_every_node_of_every_page_has_a_place_in_a_bounded_wrapper(kinds):
    chance = random.Random(kinds)
    pages = [f"<body>{mixed(chance, kinds)}<p>end</p></body>" for _ in range(300)] + ["<body>" + "".join(f"<{t} class=w>x</{t}><p>y" for t in sorted(html.BLOCK - html.NO_CONTENT)) + "</body>"]
    trees = [tree(p) for p in pages]
    halves = [html.induced(trees[:150]), html.induced(trees[150:])]
    wrapper = html.Wrapper.unpacked(html.induced(halves))
    assert sum(map(len, wrapper.levels())) <= html.MOST_NODES and all(len(n.kids) <= 2 * html.WIDEST for level in wrapper.levels() for n in level)
    assert html.Wrapper.unpacked(wrapper.packed()).packed() == wrapper.packed()
    for p in pages:
        page = html.Page(p)
        runs = html._runs(page)
        assert html._aligned(wrapper, runs) == 0
        assert [i for i, _ in html._placed(runs)[0]] == list(range(len(page.blocks)))


def test_wrappers_of_many_trees_are_merged_in_steps_and_any_order_of_rows_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(html, "MERGED_AT_ONCE", 4)
    chance = random.Random(3)
    rows = [(i, f"https://{'big' if i % 4 else f'h{i % 20}'}.org/{i}", f"<body>{mixed(chance, 5, 1)}<p>story {i}</p></body>") for i in range(200)] + [(200, "https://alone.org/", page(1)), (201, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    first = {r._host: html.Wrapper.unpacked(r._wrapper) for r in html.wrappers(df).collect()}
    again = {r._host: html.Wrapper.unpacked(r._wrapper) for r in html.wrappers(df.repartition(7, "url")).collect()}
    assert set(first) == {"big.org", *(f"h{i}.org" for i in range(0, 20, 4))}
    assert {k: w.packed() for k, w in first.items()} == {k: w.packed() for k, w in again.items()}
    for _, url, source in rows[:200]:
        assert html._aligned(first[url.split("/")[2]], html._runs(html.Page(source))) == 0


def test_pages_without_names_or_one_order_around_the_article(spark):
    chance = random.Random(2)

    def around(n):
        kinds = ["<div><p>{}</p></div>", "<div>{}</div>", "<ul><li><a href=x>{}</a></li></ul>", "<table><tr><td><a href=x>{}</a></table>", "<section>{}</section>", "<center>{}</center>"]
        return "".join(chance.choice(kinds).format(words(chance, 3)) for _ in range(n))

    pages, want = [], []
    for _ in range(400):
        body = [(chance.choice(["p", "p", "h2", "pre", "blockquote"]), words(chance, 12)) for _ in range(chance.randrange(6, 25))]
        pages.append(f"<body>{around(chance.randrange(3, 12))}<div><h1>{words(chance, 4)}</h1>{''.join(f'<{k}>{x}</{k}>' for k, x in body)}</div>{around(chance.randrange(3, 9))}</body>")
        want.append([x for _, x in body])
    got = texts(spark, pages)
    assert [g.split("\n\n")[1:] for g in got] == want
