"""Main text of layouts that few pages of a host have, or that only one page has."""

from itertools import combinations, product

import pytest

from sparkdecide.llm import html

MENU = "<nav><a href=/>Home</a></nav>"


def texts(spark, pages):
    rows = [(k, "http://h.example/a", p) for k, p in enumerate(pages)]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [x.text for x in sorted(got, key=lambda x: x.page_id)]


def test_op6_html_main_text_reads_every_layout(spark):
    pages = [f"<body class=postid-{k}>{MENU}<article id=post-{k} class=hentry{k}><p>text {k}</article>" for k in range(12)]
    pages += [f"<body>{MENU}<div class=l{chr(97 + k)}><{t}><p>other {k}</{t}></div>" for k, t in enumerate(("main", "article") * 5)]
    pages += [f"<body>{MENU}<p id=x>plain words</p><ul><li><a>link</a></ul>"]
    want = [f"text {k}" for k in range(12)] + [f"other {k}" for k in range(10)] + ["plain words"]
    assert texts(spark, pages) == want


def test_op6_html_main_text_unknown_to_the_wrapper():
    known = html.infer([f"<body>{MENU}<article><p>a b c</article>"] * 3)
    assert html.read(f"<body>{MENU}<main><p>x<aside>no</aside></main>", known) == "x"
    assert html.read(f"<body><section><article class=new><p>x</article></section>{MENU}<article><p>y</article>", known) == "x\n\ny"
    assert html.read(f"<body><article><p>y</article><section><a>l</a></section>{MENU}", known) == "y"
    assert html.read("<body><nav><main>no</main></nav><article>y</article>", known) == "y"


def test_op6_html_main_text_compares_regions_on_each_page(spark):
    pages = [f"<body>{MENU}<article><p>{'long ' * 200}{k}</article>" for k in range(5)]
    pages += [f"<body>{MENU}<main><p>short</main>", f"<body>{MENU}<div class=entry>short too</div>"]
    assert texts(spark, pages)[5:] == ["short", "short too"]
    assert texts(spark, [p.replace("</article>", "</article><div class=entry>see</div>") for p in pages[:5]])[0].endswith("long 0")


def test_op6_html_main_text_deep_pages(spark):
    assert texts(spark, ["<div>" * 3000 + "deep" + "</div>" * 3000]) == ["deep"]


def test_op6_html_main_text_template_text_is_told_by_the_host(spark):
    def page(k, note="We value you"):
        return f"<body>{MENU}<article><h1>Title {k}</h1><div class=x7><p>{note}</div><p>text {k}</article><div class=q2>always</div>"

    # inside the article nothing goes for being the same on all pages
    for n in (1, 4, 6, 60):
        assert texts(spark, [page(k) for k in range(n)]) == [f"Title {k}\n\nWe value you\n\ntext {k}" for k in range(n)]
    # pages without main groups
    plain = [f"<body><div class=x7>We value you</div><div class=y1><p>text {k}</div>" for k in range(6)]
    assert texts(spark, plain) == [f"text {k}" for k in range(6)]
    # one page alone can't know it, fewer than TEMPLATE pages don't say it, another text in its place is a slot, copies of one page are all the same
    assert html.read(plain[0]) == "We value you\n\ntext 0"
    assert texts(spark, plain[:4])[0] == "We value you\n\ntext 0"
    assert texts(spark, [*plain, plain[0].replace("value", "like")])[0] == "We value you\n\ntext 0"
    assert texts(spark, [plain[0]] * 8) == ["We value you\n\ntext 0"] * 8
    # between texts that differ, the same heading is text
    parts = [f"<body><div class=x7>We value you</div><div class=y1>Cake {k}</div><h2>Ingredients</h2><div class=y2>flour {k}</div><h3>Method</h3><div class=y3>mix {k}</div>" for k in range(600)]
    assert texts(spark, parts) == [f"Cake {k}\n\nIngredients\n\nflour {k}\n\nMethod\n\nmix {k}" for k in range(600)]
    # a group that few pages have, and a repeated one, are text
    few = [f"<body><article><p>text {k}<p>more<h2>See</h2><p>end {k}</article>" for k in range(5)]
    assert texts(spark, few + [f"<body><article><p>text {k}</article>" for k in range(9)])[0] == "text 0\n\nmore\n\nSee\n\nend 0"


@pytest.mark.parametrize("n", [4, 6, 600])
def test_op6_html_main_text_keeps_what_all_articles_have(spark, n):
    pages = [f"<article><h1>Cake {k}</h1><p>Story {k}<h2>Ingredients</h2><ul><li>flour {k}</ul><p class=author>By Jo Doe</p><h3>Method</h3><p>Mix {k}</article>" for k in range(n)]
    assert texts(spark, pages) == [f"Cake {k}\n\nStory {k}\n\nIngredients\n\nflour {k}\n\nBy Jo Doe\n\nMethod\n\nMix {k}" for k in range(n)]


def test_op6_html_main_text_odd_pages():
    deep = "<div>" * 5000 + "<article><p>deep</article>"
    assert html.read(deep, html.infer([deep, deep])) == "deep"
    one = "<article>" + "".join(f"<p class=w{'abcdefgh'[k * k % 97 % 8]}>t{k}</p>" for k in range(20_000)) + "</article>"
    two = "<article>" + "".join(f"<p class=w{'abcdefgh'[k * k % 89 % 8]}>t{k}</p>" for k in range(20_000)) + "</article>"
    assert html.read(one, html.infer([one, two])).count("\n\n") == 19_999
    assert html.read("<p>x" + '<a b="y ' * 8001) == "x"
    assert html.read("<p>1 < 2 <- 3<!" + "<!" * 8000) == "1 < 2 <- 3"
    assert html.read('<p title="a>b">x</p><p title="open>y</p><p>z') == "x\n\ny\n\nz"


def test_op6_html_main_text_alignment_is_a_longest_common_subsequence():
    lists = [list(x) for n in range(5) for x in product("abc", repeat=n)][::3]

    def longest(a, b):
        subs = [{tuple(x) for n in range(len(y) + 1) for x in combinations(y, n)} for y in (a, b)]
        return max(map(len, subs[0] & subs[1]))

    for a, b in product(lists, lists):
        pairs = html.aligned(a, b)
        assert [i for i, _ in pairs if i is not None] == list(range(len(a)))
        assert [j for _, j in pairs if j is not None] == list(range(len(b)))
        both = [(i, j) for i, j in pairs if i is not None and j is not None]
        assert all(a[i] == b[j] for i, j in both) and len(both) == longest(a, b)
