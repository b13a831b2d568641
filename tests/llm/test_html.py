from glossa.llm import html as h

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- note --><div class="ad">Buy</div>
<article><h1>Head &amp; more</h1><p><b>First  para
graph.<br><p>Second &lt;x&gt; caf&eacute;.</p><div class="share-box">Share</div><form>f<input>g</form><p>Last.</p></article>
<section id="comments"><p>nice</p></section><aside>side</aside><div role="contentinfo">legal</div><footer>&copy; x"""


def kept_of(page):
    blocks = h.blocks_of(page)
    return [t for (t, _), k in zip(blocks, h.settled([p for _, p in blocks])) if k]


def test_structure():
    assert [(t, p) for t, p in h.blocks_of(PAGE) if p == h.FURNITURE] == [(t, 0) for t in ("Site", "Home", "Buy", "Share", "fg", "nice", "side", "legal", "© x")]
    assert kept_of(PAGE) == ["Head & more", "First para graph.", "Second <x> café.", "Last."]
    assert h.blocks_of(None) == h.blocks_of("") == []
    assert kept_of("<div>a<p>b</div>c &am d") == ["a", "b", "c &am d"]


def test_neighbours():
    assert h.nearest("/a/b1", "/a/a", "/a/b2") == 1 and h.nearest("/a", "/a", "/a") == -1 and h.nearest("/a", None, None) == 0 and h.nearest("/a", None, "/z") == 1


def test_shared_is_a_longest_common_subsequence():
    import random
    from functools import cache

    def length(a, b):
        @cache
        def best(i, k):
            if i == len(a) or k == len(b):
                return 0
            return 1 + best(i + 1, k + 1) if a[i] == b[k] else max(best(i + 1, k), best(i, k + 1))

        return best(0, 0)

    def inside(x, b):
        at = iter(b)
        return all(y in at for y in x)

    own, other = "p q m1 t1 m2 t2 m3".split(), "m1 u1 m2 u2 m3 p q".split()
    assert [x for x, hit in zip(own, h.shared(own, other)) if hit] == ["m1", "m2", "m3"]
    rng = random.Random(4)
    for _ in range(2000):
        a, b = ([rng.randrange(rng.choice([2, 5, 12])) for _ in range(rng.randrange(14))] for _ in "ab")
        found = [x for x, hit in zip(a, h.shared(a, b), strict=True) if hit]
        assert len(found) == length(a, b) and inside(found, b)


#: Kinds of lines of the pages below, as HTML, and whether they belong to the main text.
KINDS = {"menu": ("<nav><a>{}</a></nav>", False), "box": ('<div class="sidebar">{}</div>', False), "line": ("<div>{}</div>", True), "para": ("<p>{}</p>", True), "note": ('<p class="notice">{}</p>', False)}


def plain(pages):
    """Expected texts from lists of lines: no parser, no code of the operator. Lines of a page are distinct, so the longest
    common subsequence is found by trying all subsequences of the lines that both pages have."""
    from itertools import combinations

    rows = sorted(pages, key=lambda p: (p[1], p[2], p[0]))
    out = {}
    for k, (i, host, path, lines) in enumerate(rows):
        scores = []
        for j in (k - 1, k + 1):
            if 0 <= j < len(rows) and rows[j][1] == host:
                n = 0
                while n < min(len(path), len(rows[j][2])) and path[n] == rows[j][2][n]:
                    n += 1
                scores.append((-n, j))
        gone = set()
        if scores:
            mine, other = [t for _, t in lines], [t for _, t in rows[min(scores)[1]][3]]
            if mine != other:
                both = [t for t in mine if t in other]
                for size in range(len(both), -1, -1):
                    hit = next((c for c in combinations(both, size) if list(c) == sorted(c, key=other.index)), None)
                    if hit is not None:
                        gone = set(hit)
                        break
        out[i] = ("\n\n".join(t for kind, t in lines if t not in gone and KINDS[kind][1]), len(gone))
    return out


def test_extract_equals_brute_force(spark):
    import random

    rng = random.Random(12)
    pages = []
    for i in range(120):
        host = f"h{i % 4}.org"
        lines = [("menu", f"Menu of {host}"), ("line", f"Welcome to {host}")]
        lines += [(rng.choice(["para", "line"]), f"Text {i} {k}") for k in range(rng.randrange(4))]
        lines += [("note", f"Note {i}"), ("line", f"Offer {rng.randrange(3)}")] * (i % 3 == 0) + [("box", f"Box {rng.randrange(3)}"), ("line", f"All rights {host}")]
        pages.append((i, host, f"/a/{rng.randrange(9)}/{rng.randrange(40)}", lines))
    pages.append((500, "lone.org", "/", [("menu", "m"), ("line", "z")]))
    pages += [(501 + k, "twin.org", "/1", [("menu", "m"), ("para", "same")]) for k in range(2)]
    html = lambda lines: "<html><body>" + "".join(KINDS[k][0].format(t) for k, t in lines) + "</body></html>"
    rows = [(i, f"http://{host.upper()}{path}", html(lines)) for i, host, path, lines in pages]
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    got = {r["page_id"]: r for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = plain(pages)
    assert {i: (r["text"], r["n_shared"]) for i, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values()) and sum(n for _, n in want.values()) > 300
    assert want[500][0] == "z" and want[501] == want[502] == ("same", 0)


def test_edges(spark):
    rows = [(1, None, None, "r"), (2, "x", "<p>only</p>", "r"), (3, "http://a.b/", "<p>" + "long &amp; " * 200_000 + "</p>", None), (3, "http://a.b/", "<p>" + "long &amp; " * 200_000 + "</p>", None), (None, "http://a.b/c", "", "r")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, row string, host int, `path` int")
    out = h.extract(docs).collect()
    assert len(out) == 5
    got = {r["page_id"]: r["text"] for r in out}
    assert got == {1: "", 2: "only", 3: ("long & " * 200_000).strip(), None: ""}


def test_differencing_on_the_given_pages(spark):
    """Most blocks that differencing deletes are furniture by structure too; no article loses a block to it."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    out = h.extract(pages).collect()
    by_structure = {r["page_id"]: "\n\n".join(kept_of(r["html"])) for r in pages.collect()}
    assert {r["page_id"]: r["text"] for r in out} == by_structure
    assert sum(r["n_shared"] > 0 for r in out) >= 1, sum(r["n_shared"] for r in out)
    print("blocks deleted by differencing:", sum(r["n_shared"] for r in out), "pages:", sum(r["n_shared"] > 0 for r in out))


def test_empty(spark):
    assert h.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
