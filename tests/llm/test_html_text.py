import html
import math
import random
import re
import time

from maskwright.llm import html_text as H


def test_pages(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in H.extract(rows).collect()}
    for r in rows.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", r.html, re.S).group(1)
        lines = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", x))).strip() for x in re.split(r"</?(?:p|h1)>", inner)]
        want = "\n".join(x for x in lines if x)
        assert got[r.page_id] == (want, len(want))


def test_parts():
    body = "<div class='sidebar'>Side text here is long enough to count</div><div id=content><p>Main para one with a lot of words.</p><p>Second &lt;b&gt; x&nbsp;y<br>z</p><ul><li>a<li>b</ul></div>"
    rest = "<div class=comments><p>reader comment</p></div><form><p>form text</p></form><div hidden>x</div>"
    assert H.main_text(f"<body><header>Site</header>{body}{rest}<footer>f</footer>") == "Main para one with a lot of words.\nSecond <b> x y z\na\nb"
    assert H.main_text("<article><h1>T</h1><p>x</p><aside>no</aside><div class='cookie-notice'>no</div></article><article class=comment>no</article>") == "T\nx"
    assert H.main_text("<div class='page sidebar-left'><article><p>kept</p></article></div>") == "kept"
    assert H.main_text("<p title='a>b'>q<p>r<script>if(a</p>b)</script> s") == "q\nr s"


def test_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "plain"), (4, "u", "<" * 40), (5, "u", "<div>" * 3000 + "deep"), (None, "u", "<p>a</p>" * 5000), (3, "u", "plain")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, n_chars int")
    got = [(r.page_id, r.text, r.n_chars) for r in H.extract(df).collect()]
    assert got[:5] == [(1, "", 0), (2, "", 0), (3, "plain", 5), (4, "<" * 40, 40), (5, "deep", 4)]
    assert got[5][1] == "\n".join("a" * 5000) and got[6] == got[2]
    assert H.extract(df.limit(0)).collect() == []


def words(n, seed=0):
    rng = random.Random(seed)
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(n)) + "."


def test_without_article():
    # no element and no name says where the text is
    menu = "<div><ul>" + "".join(f"<li><a href='/{i}'>go to section {i}</a>" for i in range(30)) + "</ul></div>"
    paras = [words(40, i) for i in range(6)]
    links = "<div><p><a>more of this</a> and <a>more of that</a></p></div>"
    page = f"<body>{menu}<div><div>{''.join(f'<p>{p}</p>' for p in paras)}</div>{links}</div><div>(c) us</div></body>"
    assert H.main_text(page) == "\n".join(paras)


def test_densities_decide(monkeypatch):
    menu = "<div><ul>" + "".join(f"<li><a href='/{i}'>go to section {i}</a>" for i in range(30)) + "</ul></div>"
    page = f"<body>{menu}<div>{''.join(f'<p>{words(40, i)}</p>' for i in range(6))}</div></body>"
    right = H.main_text(page)
    assert "go to" not in right and right.count("\n") == 5
    monkeypatch.setattr(H, "density_of", lambda *a: 1.0)
    assert H.main_text(page) != right


def test_density_by_hand():
    # 100 characters of 4 tags, 20 of them in 2 links, on a page with 30 of 200 in links
    want = 100 / 4 * math.log(100 / 20 * 4 / 2) / (1 + math.log(math.log(20 * 100 / 80 + 100 * 30 / 200 + math.e)))
    assert math.isclose(H.density_of(100, 4, 20, 2, 30 / 200), want)
    assert math.isclose(H.density_of(50, 0, 0, 0, 0.0), 50 * math.log(50) / 1)
    assert H.density_of(0, 3, 0, 1, 0.1) == 0.0


def test_names_alone_do_not_hide_the_text():
    paras = "".join(f"<p>{words(30, i)}</p>" for i in range(5))
    for name in ("content has-sidebar", "main-menu-page", "social-page"):
        got = H.main_text(f"<body><nav><a>x</a></nav><div class='{name}'>{paras}</div><div class=sidebar><p>Some side text here.</p></div></body>")
        assert got.count("\n") == 4 and "side text" not in got
    assert H.main_text(f"<main><h1>Title here</h1><div><div>{paras}</div><div class='share-buttons'>Share</div><p><a>all of it a link</a></p></div></main>").startswith("Title here\nalpha" if words(30, 0).startswith("alpha") else "Title here\n")


def test_linear_time():
    def seconds(x):
        start = time.process_time()
        H.main_text(x)
        return time.process_time() - start

    for part in ("<a ", '<a "', "<b>", "<a '>", "<p><ul><span>", "<p><h1>", "</b>", "<!", "<td>", "<li><b>", "<script", "<a b=\"'>"):
        assert seconds(part * (5_000_000 // len(part) // 5)) < 20, part
    assert seconds("<p><ul>" + "<span>" * 100_000 + "<h1>" * 100_000) < 10
    assert seconds('<a "' * 100_001 + ">" + '<a "' * 100_000) < 10


def test_links_alone_are_no_main_text():
    menu = "<ul>" + "".join(f"<li><a href='/{i}'>go to section {i}</a></li>" for i in range(20)) + "</ul>"
    assert H.main_text(f"<body><div>{menu}</div><div><p>{words(40)}</p></div></body>") == words(40)
    assert H.main_text(f"<article><p>{words(40)}</p>{menu}<p>{words(9, 1)}</p></article>") == words(40) + "\n" + words(9, 1)


def test_comments_without_a_telling_name_beside_the_article():
    page = f"<body><article><h1>Title</h1><p>{words(30)}</p><p>{words(20, 1)}</p></article><section class=responses><p>{words(25, 2)}</p><p>{words(35, 3)}</p></section></body>"
    assert H.main_text(page) == f"Title\n{words(30)}\n{words(20, 1)}"


def test_names_of_links_keep_text():
    page = "<main><p>%s</p><div class='related-work'><p>%s</p></div><div class=related><a href=x>one thing</a> <a>two</a></div></main>" % (words(30), words(20, 1))
    assert H.main_text(page) == words(30) + "\n" + words(20, 1)


def test_only_void_elements_close_themselves():
    assert H.main_text("<article><p>see <a href=/x/>the page</a> there</p><div/>more<p/>end</article>") == "see the page there\nmore\nend"
    page = H.Page("<p>see <a href=/x/>the page</a> there</p>")
    assert [raw for i, raw in page.text if page.tag[i] == "a"] == ["the page"]
    assert H.main_text("<p>a<svg><path/></svg>b<br/>c</p>") == "ab c"


def test_references_end_at_tags():
    assert H.main_text("<p>&am<b>p;lt;</b> &amp;lt; &lt;</p>") == "&amp;lt; &lt; <".replace("&amp;lt;", "&amp;lt;", 1)


def by_recursion(tree):
    """Text of the node with the greatest density sum, its densities computed recursively; ``tree`` is (tag, children or text)."""

    def measure(t, linked=False):
        tag, inner = t
        linked = linked or tag == "a"
        if isinstance(inner, str):
            return len(inner), 0, len(inner) * linked, 0
        total = [0, 0, 0, 0]
        for c in inner:
            for k, x in enumerate(measure(c, linked)):
                total[k] += x
            if c[0] != "#":
                total[1] += 1
                total[3] += c[0] == "a"
        return total

    whole = measure(tree)
    share = whole[2] / max(1, whole[0])
    found = []

    def sums(t):
        blocks = [c for c in t[1] if c[0] in ("div", "p", "section")] if not isinstance(t[1], str) else []
        own = H.density_of(*measure(t), share)
        total = sum(H.density_of(*measure(c), share) for c in blocks) or own
        found.append((total, measure(t)[0], t))
        for c in blocks:
            sums(c)

    sums(tree)
    return max(found, key=lambda x: x[:2])[2]


def test_the_heart_of_random_pages():
    rng, same = random.Random(4), 0

    def grow(depth):
        kind = rng.choice(["p", "div", "section"]) if depth else "div"
        if kind == "p" or depth > 3:
            parts = [("#", words(rng.randrange(1, 30), rng.random()))]
            if rng.random() < 0.3:
                parts.append(("a", [("#", words(rng.randrange(1, 8), rng.random()))]))
            return ("p", parts)
        return (kind, [grow(depth + 1) for _ in range(rng.randrange(1, 5))])

    def show(t):
        return t[1] if t[0] == "#" else f"<{t[0]}>" + "".join(map(show, t[1])) + f"</{t[0]}>"

    def plain(t):
        return t[1] if t[0] == "#" else "".join(map(plain, t[1]))

    for _ in range(150):
        tree = ("html", [("body", [grow(0) for _ in range(rng.randrange(1, 4))])])
        got = H.main_text(show(tree)).replace("\n", "")
        heart = by_recursion(("html", tree[1][0][1]))
        texts = [plain(t) for t in leaves(heart)]
        assert all(t in got for t in texts), (show(tree), got)
        same += len(got) < len(plain(tree))
    assert same > 20


def leaves(t):
    """Paragraphs below a node that are not mostly links."""
    if t[0] == "p":
        return [t]
    return [x for c in t[1] if c[0] != "#" for x in leaves(c)]
