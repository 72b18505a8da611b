"""Main text of pages with many kinds of clutter."""

import math
import os
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from docengine.llm import html_extract

MENU = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>'


def page(body, head="<title>T</title><style>p{}</style><script>var t='</p>';</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


CASES = {
    "plain": (page(f"{MENU}<div class='ad'>Buy now</div><article><h1>Title &amp; more</h1><p><b>One\n two<br>three.<p>Fo<i>ur</i> &eacute;&#x41;&nbsp;x</p></article><footer>&copy; me</footer>"), "Title & more\nOne two three.\nFour éA x"),
    "truncated": ("<html><body><article><h1>A</h1><p>b c", "A\nb c"),
    "comments": (page("<header>Site</header><main><p>Text.</p><section id='comments'><article class='comment'><p>I disagree</p></article></section></main><aside>More</aside>"), "Text."),
    "no article": (page(f"{MENU}<div class='cookie-banner'>Accept</div><div><p>Only text</p></div><form>Search <input></form>"), "Only text"),
    "comment and quotes": ("<article><!-- <p>no</p> --><p title='a>b'>yes</p><p hidden>no</p><p style='display: none'>no</p></article>", "yes"),
    "not tags": ("<article>1 < 2 and 3 > 2 <3 &lt;b&gt;</article>", "1 < 2 and 3 > 2 <3 <b>"),
    "list": ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a\nb\nc\nd"),
    "empty": ("", ""),
    "null": (None, ""),
    "unclosed script": ("<article><p>a</p><script>let x = 1", "a"),
}


@pytest.mark.parametrize("case", CASES)
def test_main_text(case):
    text, want = CASES[case]
    assert html_extract.main_text(html_extract.Parser(), text or "", frozenset())[0] == want


def test_style_trees_find_what_names_do_not(spark):
    """Repeated blocks in nameless elements go where a host shows them on many pages; copied articles stay."""
    clutter = "<div id='x9'><div>Our house rules</div><div>Follow us</div></div>"
    rows = [(i, f"http://h.example/{i}", page(f"{clutter}<div id='z'><p>Text number {i}</p><p>and {i * 7} words</p></div>"), 0) for i in range(30)]
    rows += [(100 + i, f"http://h.example/c{i}", page(f"{clutter}<article><p>The same article</p></article>"), 0) for i in range(30)]
    rows += [(200, None, page(f"{clutter}<p>Alone</p>"), 0), (201, "no host", None, 0), (None, "http://h.example/1", "", 0), (202, "http://single.example/", page(f"{clutter}<p>Alone</p>"), 0)]
    pages = spark.createDataFrame(rows + rows[:1], "page_id long, url string, html string, _host int")
    got = html_extract.extract_main_text(pages, carry=("page_id",)).collect()
    assert len(got) == len(rows) + 1
    texts = {r["_carry_page_id"]: r["_text"] for r in got}
    for i in range(30):
        assert texts[i] == f"Text number {i}\nand {i * 7} words"
        assert texts[100 + i] == "The same article"
    assert texts[200] == texts[202] == "Our house rules\nFollow us\nAlone"
    assert texts[201] == texts[None] == ""
    assert html_extract.extract_main_text(pages.limit(0)).count() == 0


def test_very_long_page():
    body = "<p>" + "word " * 10 + "</p>"
    text = html_extract.main_text(html_extract.Parser(), f"<article>{body * 20_000}</article>", frozenset())[0]
    assert len(text.split("\n")) == 20_000
    assert html_extract.main_text(html_extract.Parser(), "<div>" * 20_000 + "deep", frozenset())[0] == "deep"


TABLES = "/root/testdata/sf0.01"


def test_content_importance_against_plain_counting(spark):
    """Features, entropies and the weight of other hosts' pages, counted page by page."""
    menu = "<nav><a href='/x'>One</a><a href='/y'>Two</a></nav>"
    rows = [(f"h{i % 3}.example", page(f"{menu}<div class='a'>Part {i}. Same. Word{'x' * (i % 4)}!</div><p>Unique{chr(65 + i)}.</p>")) for i in range(24)]
    rows += [(None, rows[0][1]), ("alone.example", rows[0][1])]
    parser, pages_of, seen = html_extract.Parser(), defaultdict(lambda: defaultdict(Counter)), defaultdict(Counter)
    for host, text in rows:
        if host is None:
            continue
        tree, links = {}, []
        blocks = parser.read(text, tree=tree, links=links)
        seen[host].update({0, *tree})
        for path, feature in {(n.path, f) for t, n in blocks for f in html_extract.features(t)} | {(p, ">" + x) for p, x in links}:
            pages_of[host][path][feature] += 1
    want = {}
    for host, paths in pages_of.items():
        for path, counts in paths.items():
            m, every = seen[host][path], sum((pages_of[h][path] for h in pages_of), Counter())
            total, weight, value = sum(seen[h][path] for h in seen), 0.0, 0.0
            if m > 1:
                value = m * sum(map(math.log, counts.values())) / len(counts) / math.log(m)
            if total > m:
                weight = html_extract.PRIOR_PAGES
                value += weight * sum(map(math.log, every.values())) / len(every) / math.log(total)
            want[host, path] = 1 - value / (m + weight)
    got = html_extract.style_tree(spark.createDataFrame(rows, "_host string, _page string")).where("_content is not null").collect()
    assert {(r["_host"], r["_path"]) for r in got} == set(want)
    assert all(abs(r["_content"] - want[r["_host"], r["_path"]]) < 1e-9 for r in got)


@pytest.mark.skipif(not os.path.exists(TABLES), reason="no tables")
def test_trees_decide_where_names_say_nothing(spark):
    """All element and class names made neutral: the trees alone keep the article's characters and remove the clutter's."""
    pages = spark.read.parquet(f"{TABLES}/pages.parquet")
    neutral = F.regexp_replace(F.regexp_replace("html", r"<(/?)(nav|article|footer|aside|header|main)\b", r"<$1div"), ' class="ad"', "")
    found = {r["_carry_page_id"]: r for r in html_extract.extract_main_text(pages.withColumn("html", neutral), carry=("page_id",)).collect()}
    parser, sizes = html_extract.Parser(), Counter()
    for r in pages.collect():
        left = Counter(found[r["page_id"]]["_text"].split("\n"))
        assert found[r["page_id"]]["_by_names"] == 0
        for text, node in parser.read(r["html"] or ""):
            kind = "article" if node.article else "clutter"
            sizes[kind] += len(text)
            if left[text]:
                left[text] -= 1
                sizes[f"kept {kind}"] += len(text)
    assert sizes["kept article"] >= 0.98 * sizes["article"]
    assert sizes["kept clutter"] <= 0.1 * sizes["clutter"]
