import random

from tessera.llm import html_extract, url_filter

KIND = "page_id long, url string, html string, host string, text string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], KIND)


FRAME = (
    "<html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head><body class=\"has-sidebar\"><header><h1>Site</h1></header><nav><a href=/>Home</a></nav>"
    "<div class='cookie-notice'>We use cookies</div><article><h1>Head &amp; line</h1><p>{}</p><div class=ad>buy</div><p>Two <b>pa</b>rts<br>here&nbsp;now<form>mail</form></p></article>"
    "<aside>more</aside><section id=comments><article class=comment>first!</article></section><footer>&copy; x</footer></body></html>"
)


def test_article_only(spark):
    """What all pages of a host share inside a marked article stays, however many pages there are."""
    rows = [(1000 * n + k, f"http://h{n}.example/{k}", FRAME.format(f"Story {k}")) for n in (1, 2, 3, 19, 20, 30) for k in range(n)]
    got = {r["page_id"]: r["text"] for r in html_extract.op8(pages(spark, rows)).collect()}
    assert got == {i: f"Head & line Story {i % 1000} Two parts here now" for i, _, _ in rows}


def test_names_of_parts(spark):
    page = "<article><p>A</p><div class='{}'><p>B</p></div></article>"
    kept = ["content-with-sidebar", "social-science", "has-ads", "adventure", "legal", "response-theory", "shareholder", "ad-free-content", "no-sidebar", "comment-theory"]
    gone = ["ad", "cookie-notice", "site-footer", "navBar", "ad-slot-3", "x comments", "sidebar_left", "AD", "post-share", "entryComments", "article__ad", "reader-comment-list"]
    rows = [(k, f"http://n{k}.example/", page.format(c)) for k, c in enumerate(kept + gone)]
    got = {r["page_id"]: r["text"] for r in html_extract.op8(pages(spark, rows)).collect()}
    assert [got[k] for k in range(len(rows))] == ["A B"] * len(kept) + ["A"] * len(gone)


def test_frame_chooses_the_article(spark):
    page = "<div class=top><p>Top story of the day</p></div><div class=body><article class=story><h1>T{0}</h1><p>Text {0}</p></article></div><div class=more>{1}</div>"
    card = "<article class=card><p>Read also {}</p></article>"
    rows = [(k, f"http://cards.example/{k}", page.format(k, "".join(card.format(f"{k}.{i}") for i in range(k % 3)))) for k in range(6)]
    rows.append((50, "http://alone.example/", page.format(50, card.format(7))))
    got = {r["page_id"]: r["text"] for r in html_extract.op8(pages(spark, rows)).collect()}
    assert [got[k] for k in range(6)] == [f"T{k} Text {k}" for k in range(6)]
    assert got[50] == "T50 Text 50 Read also 7"  # one page has no template


def plain_texts(rows):
    """The same deduction over dictionaries, host by host, with pages compared outright."""
    parser = html_extract.Parser()
    hosts, out = {}, {}
    for i, host, page in rows:
        hosts.setdefault(host, {})[page] = None
    for host, found in hosts.items():
        tokens = {p: parser.parse(p)[1] for p in found}
        every = {t for own in tokens.values() for t in own}
        vector = {t: tuple(tokens[p].get(t, [0])[0] for p in found) for t in every}
        parent = {t: next((html_extract.ELEMENT, own[t][2]) for own in tokens.values() if t in own) for t in every}
        parent = {t: up if up in every else (html_extract.MARKED, up[1]) for t, up in parent.items()}
        need = max(3, -(-len(found) // 2))
        classes = {}
        for t in every:
            if sum(n > 0 for n in vector[t]) >= need:
                classes.setdefault(vector[t], set()).add(t)
        ups = {}
        for v, own in classes.items():
            orders = {tuple(sorted(own, key=lambda t: tokens[p][t][1])) for p, n in zip(found, v) if n}
            up = {vector[parent[t]] for t in own} - {v}
            if len(orders) == 1 and len(up) <= 1 and any(k != html_extract.TEXT for k, _ in own):
                ups[v] = up.pop() if up else None
        nested = {v for v, up in ups.items() if up is None}
        for _ in ups:
            nested |= {v for v, up in ups.items() if up in nested}
        texts = {t for v in nested for k, t in classes[v] if k == html_extract.TEXT}
        frame = {t for v in nested if ups[v] is None for k, t in classes[v] if k == html_extract.MARKED}
        for p in found:
            marked, blocks = html_extract.slots(parser.parse(p)[0])
            if marked:
                blocks = [b for b in blocks if b[1] in frame] if any(b[1] in frame for b in blocks) else blocks
            else:
                blocks = [b for b in blocks if b[1] not in texts]
            out[host, p] = " ".join(b[0] for b in blocks)
    return [(i, out[host, page]) for i, host, page in rows]


def random_page(rng):
    parts = ["<div class=top><p>Welcome to us</p></div>", f"<div class=x><p>Part {rng.randrange(3)}</p><p>Own {rng.random()}</p></div>"]
    if rng.random() < 0.6:
        parts.append(f"<div class=box><p>Told by the {rng.choice('ab')}</p><span>{rng.choice(['same', 'other'])}</span></div>")
    if rng.random() < 0.5:
        parts.append("<section class=deep><div class=deeper><p>Deep one</p></div></section>")
    if rng.random() < 0.3:
        parts.append(f"<article class=story><p>Story {rng.randrange(9)}</p></article>")
    if rng.random() < 0.3:
        parts.append(f"<article class=card><p>Card {rng.randrange(9)}</p></article>")
    if rng.random() < 0.3:
        rng.shuffle(parts)
    return "<html><body>" + "".join(parts) + "<div class=end>All rights with us</div></body></html>"


def test_template_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for h in range(24):
        for _ in range(rng.randrange(1, 12)):
            rows.append((len(rows), f"h{h}.example", random_page(rng)))
            if rng.random() < 0.1:
                rows.append((len(rows), f"h{h}.example", rows[-1][2]))
    fixed = "<div class=top><p>Welcome to us</p></div><div class=x><p>Own {0}</p></div><div class=box><p>Told by us</p></div><div class=end>All rights with us</div>"
    rows += [(len(rows) + k, "fixed.example", fixed.format(k)) for k in range(5)]
    got = {r["page_id"]: r["text"] for r in html_extract.op8(pages(spark, [(i, f"http://{h}/{i}", p) for i, h, p in rows])).collect()}
    assert sorted(got.items()) == sorted(plain_texts(rows))
    assert [got[i] for i, h, _ in rows if h == "fixed.example"] == [f"Own {k}" for k in range(5)]


def test_single_pages_and_odd_rows(spark):
    rows = [
        (1, "http://b.example/1", FRAME.format("Only")),
        (2, None, None),
        (3, "nonsense", ""),
        (4, "http://c.example", "plain &lt;text&gt; without markup"),
        (4, "http://c.example", "plain &lt;text&gt; without markup"),
        (None, "http://d.example", "<article><p>open <i>end <!-- cut"),
        (6, "http://e.example", "<div><p>One</p><ul><li><a href=x>menu</a></li></ul><p>a < b</p></div>"),
        (7, "http://f.example", "<article>" + "<p>long text</p>" * 20_000 + "</article>"),
    ]
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html_extract.op8(pages(spark, rows)).collect()]
    assert len(got) == len(rows) and all(n == len(t) for _, t, n in got)
    found = {i: t for i, t, _ in got}
    assert found[1] == "Head & line Only Two parts here now"
    assert found[2] == "" and found[3] == ""
    assert found[4] == "plain <text> without markup"
    assert found[None] == "open end"
    assert found[6] == "One a < b"
    assert found[7] == " ".join(["long text"] * 20_000)
    assert html_extract.op8(pages(spark, [])).count() == 0


def test_copies_are_not_a_template(spark):
    rows = [(k, f"http://g.example/{k}", FRAME.format("The same story")) for k in range(60)]
    assert {r["text"] for r in html_extract.op8(pages(spark, rows)).collect()} == {"Head & line The same story Two parts here now"}


def test_template_of_a_small_host_without_marks(spark):
    page = "<div class=x><div class=y>Home Shop Contact</div></div><div class=z><p>Story {0}</p><p>{1}</p></div><div class=w>All rights with us</div>"
    rows = [(k, f"http://h.example/{k}", page.format(k, "Told twice" if k < 2 else f"More {k}")) for k in range(4)]
    rows += [(10 + k, f"http://two.example/{k}", page.format(k, "End")) for k in range(2)]
    got = {r["page_id"]: r["text"] for r in html_extract.op8(pages(spark, rows)).collect()}
    assert [got[k] for k in range(4)] == ["Story 0 Told twice", "Story 1 Told twice", "Story 2 More 2", "Story 3 More 3"]
    assert got[10] == "Home Shop Contact Story 0 End All rights with us"  # two pages are too few to tell


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min((i for i in (path.find(c) for c in "?#") if i >= 0), default=len(path))]
    fits = [r.name for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=len, default=None)


def test_rules_against_plain_python(spark):
    urls = [
        "http://Example.com/en/1", "http://www.example.com/en/1", "http://m.www.example.com/en/", "https://x.net/fr/1?a=1", "https://x.net/es", "https://net/es/", "ftp://a.com", "http://a.com?x=/",
        "http://a.com/", "http://notexample.com/en/", "no scheme", None, "", "://", "http://ÄB.org/en/#f", "http://a.org/x://b.com/", "http://a.com#/en/", "http://u@a.com:80/x",
    ]
    got = {r["page_id"]: r for r in url_filter.op9(pages(spark, list(zip(range(len(urls)), urls, ["<a>"] * len(urls))))).collect()}
    verdict = {r.name: r.verdict for r in url_filter.RULES}
    for k, u in enumerate(urls):
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == plain_rule(u), u
        if got[k]["rule"]:
            assert got[k]["verdict"] == verdict[got[k]["rule"]]
        else:
            assert got[k]["verdict"] == "allow"
    assert url_filter.op9(pages(spark, [])).count() == 0


def plain_rank(edges, seeds, rounds):
    out = {}
    for s, _ in edges:
        out[s] = out.get(s, 0) + 1
    total = sum(seeds.values())
    start = {h: w / total for h, w in seeds.items()}
    score = dict(start)
    for _ in range(rounds):
        new = {h: w * (1 - url_filter.DAMPING) for h, w in start.items()}
        for s, d in edges:
            new[d] = new.get(d, 0) + url_filter.DAMPING * score.get(s, 0) / out[s]
        score = new
    return score


def test_distrust_flows_back_along_links(spark):
    link = '<a href="http://{}/x">l</a>'
    rows = [
        (1, "http://bad.net/es/1", ""),
        (2, "http://friend.org/1", link.format("bad.net")),
        (3, "http://second.org/1", link.format("friend.org") + link.format("friend.org")),
        (4, "http://good.com/1", link.format("liked.org") + "<a href='//Other.ORG?x'>"),
        (5, "http://liked.org/1", None),
        (6, "http://other.org/1", None),
    ]
    got = {r["page_id"]: r["verdict"] for r in url_filter.op9(pages(spark, rows)).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow"}
    edges = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "a")]
    table = spark.createDataFrame([("a", "b", 0.5), ("a", "c", 0.5), ("b", "c", 1.0), ("c", "a", 1.0)], "src string, dst string, weight double")
    found = url_filter.spread(table, spark.createDataFrame([("a", 2.0), ("b", 1.0)], "host string, weight double"), 7)
    want = plain_rank(edges, {"a": 2.0, "b": 1.0}, 7)
    assert {r["host"]: round(r["score"], 9) for r in found.collect()} == {h: round(s, 9) for h, s in want.items()}
