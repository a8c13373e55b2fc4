import pytest

from tidemark.llm import html_extract as H


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>a<p>b<div>c</div>d &amp; &nbsp; e<br>f", ["a", "b", "c", "d & e f"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ('<p>x < y <b>bo<i>ld</b> y</i> "<a title="a>b">L</a>', ['x < y bold y "L']),
        ("<!-- never closed <p>a", []),
        ("<div id='comments'>no</div><p>yes</p>", ["yes"]),
        ('<p title="unclosed>a</p><p>b</p>', ["a", "b"]),
        ("<div hidden>no</div><p>ok", ["ok"]),
        ("<header><h1>site</h1></header><main><header><h1>T</h1></header><p>t</p><form>q</form></main>", ["T", "t"]),
        ("<div>" * 20000 + "deep", ["deep"]),
        ("<div class='social-science'><p>Essay</p></div><div class='share-buttons'>s</div><div id='related_posts'>r</div><p class='notice-of-motion'>m", ["Essay", "m"]),
        ("<article><p>Let <math><mi>x</mi></math> be. a &am<b>p;</b> &lt<!-- c -->; b", ["Let x be. a &amp; <; b"]),
        ("<table><tr><td><div>a<table><tr><td>b</div></td></tr></table>c</table>d", ["a", "b", "c", "d"]),
        ("", []),
        ("<" * 50000, ["<" * 50000]),
        ('<a b="' * 3000, []),
        ("<div class='page sidebar-left'><main class='no-sidebar'><p>in</p><div class=sidebarBox>x</div></main><div id=cookiebar>y</div></div>", ["in"]),
        ("<article class='post comments-open'><p>a</p></article><article class='comment'><p>b</p></article>", ["a"]),
        ("<nav>menu</nav><article><h1>T</h1><p>one</p><aside>x</aside><script>var a='</p>'</script><p>two</p></article><footer>f</footer>", ["T", "one", "two"]),
    ],
)
def test_blocks(page, want):
    assert H.blocks(H.parse(page)) == want


def pages(n=40):
    out = []
    for i in range(n):
        box = "<div><b>Follow</b> our stories every single day</div>"
        out.append((i, f"http://site{i % 2}.example.org/{i}", f"<body><div>Welcome to the site</div><article><h1>Title {i}</h1><p>Body of page {i}.</p><p>A sentence that all share.</p>{box}</article><div>Owned by nobody</div></body>"))
    out += [(100 + i, f"http://rare.example.org/{i}", f"<body><div>Shared words</div><div>own {i}</div></body>") for i in range(3)]
    out += [(200 + i, "http://site0.example.org/copy", "<body><div>Welcome to the site</div><div>A copied page without an article</div></body>") for i in range(30)]
    out += [(300, None, "<p>no address</p>"), (301, "http://site0.example.org/x", None), (None, "::bad::", ""), (303, "http://site1.example.org/z", "<p>" + "word " * 100000)]
    return out


def test_templates_go_and_articles_stay(spark):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = H.extract(df).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    for i in range(40):
        assert text[i] == f"Title {i}\nBody of page {i}.\nA sentence that all share."
    assert text[100] == "Shared words\nown 0"  # three pages are not many
    assert text[200] == "A copied page without an article"  # copies are one page
    assert (text[300], text[301], text[None]) == ("no address", "", "")
    assert text[303] == " ".join(["word"] * 100000)
    empty = H.extract(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["page_id", "url", "text"]


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "http://a.b/c", "<p>x</p>", "m", 3)], "page_id long, url string, html string, marks string, k1 int")
    assert H.extract(df).first().asDict() == {"page_id": 1, "url": "http://a.b/c", "marks": "m", "k1": 3, "text": "x"}


def spelled(node):
    """A subtree as plain text, the template key without hashes."""
    parts = [" ".join(k.split()) if k.__class__ is str else spelled(k) for k in node.kids]
    return f"<{node.tag}|" + "|".join(p for p in parts if p) + ">"


def test_templates_equal_counting_in_plain_python(spark, sf):
    """Pages of the table without their article element, so that templates decide."""
    import re
    from collections import defaultdict

    box = "<div>Welcome to all</div>", "<section><p>Read on</p><div>and <b>on</b></div></section>"
    rows = [(r.page_id, r.url, re.sub(r"</?article[^>]*>", "", r.html or "").replace("<body>", "<body>" + box[r.page_id % 2])) for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/pages.parquet").collect()]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    seen, totals, trees = defaultdict(set), defaultdict(set), {}
    for i, url, page in rows:
        root = trees[i] = H.parse(page)
        host, text = H.host_of(url), "\n".join(H.blocks(root))
        if not page or host is None:
            continue
        totals[host].add(text)
        stack = [root]
        while stack:
            node = stack.pop()
            stack += [k for k in node.kids if k.__class__ is not str]
            if node.n_text and node.tag in H.BLOCK - set("html body head article main".split()):
                seen[host, spelled(node)].add(text)
    template = {k for k, v in seen.items() if len(v) >= 5 and len(v) >= min(50.0, 0.05 * len(totals[k[0]]))}
    assert template
    want = {}
    for i, url, page in rows:
        marks, stack = set(), [trees[i]]
        while stack:
            node = stack.pop()
            stack += [k for k in node.kids if k.__class__ is not str]
            if (H.host_of(url), spelled(node)) in template:
                marks.add(node.hash)
        want[i] = "\n".join(H.blocks(trees[i], frozenset(marks))) if page else ""
    assert {r.page_id: r.text for r in H.extract(df).collect()} == want


@pytest.mark.parametrize("page", ["<div>" * 60_000 + "</span>" * 60_000, "<p>" + "<b>" * 60_000 + "</div>" * 60_000, "<table><tr><td>" + "<i>" * 60_000 + "</div>" * 60_000, "<ul><li>" * 60_000, '<a b="' * 100_000])
def test_deep_pages_take_linear_time(page):
    import time

    began = time.perf_counter()
    H.blocks(H.parse(page))
    assert time.perf_counter() - began < 6
