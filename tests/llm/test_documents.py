"""Operators 5, 7, 8 and the pipeline: brute force and planted cases."""

import os
import random
import re

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from sylvan.llm import decontaminate, html_text, pii, quality, simhash

SF = "/root/testdata/sf0.001"


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def slow_groups(rows, radius=4):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= radius:
                parent[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return {d: min(x for x in g if x is not None) for g in groups.values() for d in g if d is not None}


def near_copies(rng, n):
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(60, 200))]
        texts.append(" ".join(w))
        for _ in range(rng.randint(0, 3)):
            w = list(w)
            w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("tile", [7, 8192])
def test_simhash_groups(spark, tile):
    texts = [None, "", "one two", "One TWO", "a b c d", " \n", "x y z " * 20_000, *near_copies(random.Random(6), 25)]
    texts += texts[10:14]
    d = spark.createDataFrame([(100 - i, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    got = {r["doc_id"]: r for r in simhash.grouped(d, tile=tile).collect()}
    want = slow_groups([(100 - i, slow_fingerprint(t)) for i, t in enumerate(texts)])
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert int(got[100 - i]["fingerprint"], 16) == slow_fingerprint(t)
        assert got[100 - i]["component_id"] == want[100 - i]
    kept = simhash.without_copies(d, tile=tile)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values())) and kept.columns == d.columns


def test_simhash_corner_cases(spark):
    d = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (None, "z y x w v")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in simhash.grouped(d).collect()) == [(0, 0), (0, 1), (1, 1), (1, 1)]
    assert simhash.without_copies(d).count() == 2
    assert simhash.grouped(d.limit(0)).count() == 0 and simhash.without_copies(d.limit(0)).count() == 0


def test_forest_loses_no_group():
    rng = np.random.default_rng(7)
    centres = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    f = np.unique(np.concatenate([centres, *[centres ^ (np.uint64(1) << rng.integers(0, 63, 40).astype(np.uint64)) for _ in range(60)]]))
    u, v = simhash.forest(f, None, 4)
    g = simhash.Groups(len(f))
    at = {x: i for i, x in enumerate(f.tolist())}
    g.join(np.array([at[x] for x in u.tolist()]), np.array([at[x] for x in v.tolist()]))
    h = simhash.Groups(len(f))
    i, j = np.nonzero(np.bitwise_count(f[:, None] ^ f[None]) <= 4)
    h.join(i, j)
    assert (g.root == h.root).all() and len(u) < len(f)


def test_star_groups(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randint(2000, 2300), rng.randint(2000, 2300)) for _ in range(200)]
    got = {r["u"]: r["root"] for r in simhash.star_groups(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent if find(x) != x}


def test_pii_base_patterns():
    rng = random.Random(9)
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = lambda s: re.sub("[^0-9]", "", s)
    ok = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": lambda s: 16 <= len(digits(s)) <= 19 and pii.luhn(digits(s)), "phone": lambda s: 8 <= len(digits(s)) <= 15}
    for _ in range(3000):
        t = "".join(rng.choice("a@.b-1 +2(3)4.5é0@") for _ in range(rng.randint(0, 80)))
        want = [(k, *m.span()) for k, p in patterns.items() for m in re.finditer(p, t, re.ASCII) if ok[k](m[0])]
        assert pii.base_spans(t) == want
    assert pii.luhn("4785380592391139") and not pii.luhn("4785380592391138")
    pii.base_spans("a" * 200_000 + "1" * 200_000 + "." * 200_000)  # linear


def train_texts():
    rng, out = random.Random(10), []
    for i in range(120):
        out.append(f"write to user{i}@site{i % 7}.org or call +1 (8{i % 10}0) 555-{1000 + i} from 10.{i}.3.{i % 9} with 4785-3805-9239-1139 not {rng.randint(10**9, 10**15)} on 2020-01-{i % 28 + 1:02d} v1.2.{i}")
    return out


def test_pii_field_adds_what_patterns_drop():
    field = pii.trained(train_texts())
    for text, kind, found in [("x 1234 4785380592391139 12", "card", "4785380592391139"), ("card 4785-3805-9239-1139-77", "card", "4785-3805-9239-1139")]:
        base, every = pii.all_spans(text, field)
        assert not base and [(k, text[a:b]) for k, a, b in every] == [(kind, found)]
    for clean in ("plain words only", "born 1999-12-31 in 10115 Berlin", "4785380592391138", "version 1.2.3"):
        assert pii.all_spans(clean, field)[1] == []
    assert pii.all_spans("x 1234 4785380592391139 12", pii.Field())[1] == []


def test_pii_exact_inference():
    rng, field = random.Random(11), pii.Field()
    text = "12 34 56@a.b 7890"
    cuts = pii.pieces(text, 0, len(text))
    spans = pii.candidates(text, cuts)
    for found in spans.values():
        for f in found:
            for k in pii.KINDS:
                field.w[k, f] = rng.uniform(-2, 2)

    def best(j):
        return 0.0 if j == 0 else max([best(j - 1), *(best(i) + field.score(k, f) for (i, e), f in spans.items() if e == j for k in pii.KINDS)])

    assert abs(sum(s for *_, s in field.best(spans, len(cuts))) - best(len(cuts))) < 1e-9


def test_pii_table(spark):
    texts = [None, "", "mail a@b.org, 1.2.3.4", "y" * 300_000, "mail a@b.org, 1.2.3.4"]
    d = spark.createDataFrame([(i, t, "p") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r["doc_id"]: r["pii"] for r in pii.found(d, pii.fitted(d), mask=True).collect()}
    assert got[2]["spans"].startswith("email:5:12,ip:14:21") and got[2]["masked"] == "mail [EMAIL], [IP]" and got[0]["masked"] == "" and got[3]["n_email"] == 0
    assert pii.found(d.limit(0), pii.fitted(d.limit(0))).count() == 0
    assert pii.masked("abcdef", [("ip", 1, 3), ("card", 2, 4)]) == "a[IP]ef"


def test_common_lines():
    rng = random.Random(12)
    for _ in range(1500):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        on = html_text.common_lines(a, b)
        rest = iter(b)
        assert sum(on) == table[-1][-1] and all(x in rest for x, k in zip(a, on) if k)


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body class='has-sidebar'><nav><a href='/'>Home</a></nav><script>var t='</p>';</script>{body}<footer>&copy; x</footer></body></html>"


def test_page_lines():
    art = page("<div class=ad>Buy</div><article><header><h1>Title</h1></header><p>One&nbsp;&amp; <b>two\n three<br>four<p>Last</p><section id='comments'><p>me too</p></section><form>in</form></article><aside>no</aside>")
    assert html_text.page_lines(art) == [("Title", True), ("One & two three four", True), ("Last", True)]
    assert html_text.page_lines(None) == [] and html_text.page_lines("") == [] and html_text.page_lines("<p>a<p>b") == [("a", False), ("b", False)]
    assert html_text.page_lines("<div>" * 50_000 + "x") == [("x", False)]


def test_article_in_a_wrapper_with_a_telling_name():
    text = "<article><p>First of the article<p>Second</article>"
    for wrapper in ("div class='layout has-sidebar'", "div class='content no-ads'", "div id='search-results'", "div class='search'", "div id=content role=search", "form", "div class=widget><section class=overlay"):
        lines = html_text.page_lines(page(f"<div>Hi</div><{wrapper}>{text}</{wrapper.split()[0]}><p>by"))
        assert lines == [("First of the article", True), ("Second", True)], wrapper
        assert html_text.page_lines(page(f"<{wrapper}><main><p>One</main></{wrapper.split()[0]}>")) == [("One", True)], wrapper
    own = "<div>The text of a page without article, longer than its teasers</div>"
    assert html_text.page_lines(page(f"{own}<div class='related'>{text}</div>"))[0][0] == "The text of a page without article, longer than its teasers"
    assert html_text.page_lines(page(f"<article>Own</article><div class='related'>{text}</div>")) == [("Own", True)]
    assert html_text.page_lines(page(f"<aside>{text}</aside><div hidden>{text}</div><div class='cookie-notice'>no</div><article class='comment'>no</article>")) == []


def test_differencing(spark):
    frame = "<div>Welcome to our site, enjoy</div><div>{}</div><div>Second part of page {}</div><div>All about this site and more</div>"
    pages = [(i, f"http://h.org/a/{i}", f"<body>{frame.format('Own words of page ' + str(i) * 30, i)}</body>") for i in range(6)]
    pages += [(10, "http://k.org/x/1", "<p>same text</p>"), (11, "http://k.org/x/2", "<p>same text</p>"), (12, None, None), (13, "", ""), (14, "http://z.org/", page("<article><p>only</p></article>")), (14, "http://z.org/", page("<article><p>only</p></article>"))]
    d = spark.createDataFrame([(*p, "c") for p in pages], "page_id long, url string, html string, text string")
    got = [tuple(r) for r in html_text.extracted(d).collect()]
    by_id = {r[0]: r for r in got}
    assert len(got) == len(pages)
    for i in range(6):
        assert by_id[i][2] == f"Own words of page {str(i) * 30}\nSecond part of page {i}" and by_id[i][3] == len(by_id[i][2])
    assert by_id[10][2] == by_id[11][2] == "same text"  # copies tell nothing about the frame
    assert by_id[12][2] == by_id[13][2] == "" and by_id[14][2] == "only"
    assert html_text.extracted(d.limit(0)).count() == 0


def test_differencing_with_a_long_frame_and_copies(spark):
    frame = [f"Frame line {i} of the site, as long as it is" for i in range(7)]
    body = lambda *own: "".join(f"<div>{x}</div>" for x in (*frame[:4], *own, *frame[4:]))
    texts = [f"Own words of page {i}, in one line of length" for i in range(3)]
    own = [(i, f"http://h.org/a/{i}", body(f"{t} 1", f"{t} 2", f"{t} 3"), [f"{t} {k}" for k in (1, 2, 3)]) for i, t in enumerate(texts)]
    assert all(sum(map(len, frame)) > 0.69 * (sum(map(len, frame)) + sum(map(len, x[3]))) for x in own)
    # nine equal copies in a row, nine excerpts of one text in a row, then another page
    own += [(10 + i, f"http://c.org/a/{i}", body("Copied text"), ["Copied text"]) for i in range(9)] + [(19, "http://c.org/z", body("Other text"), ["Other text"])]
    own += [(20 + i, f"http://n.org/a/{i}", body(*[f"Part {k}" for k in range(i + 1)]), [f"Part {k}" for k in range(i + 1)]) for i in range(9)] + [(30 + i, f"http://n.org/z/{i}", body(f"Other {i}"), [f"Other {i}"]) for i in range(16)]
    # the only page that is no copy stands three places away
    own += [(50 + i, f"http://t.org/a/{i}", body(*[f"Part {k}" for k in range(i + 1)]), [f"Part {k}" for k in range(i + 1)]) for i in range(3)] + [(53, "http://t.org/z", body("Other"), ["Other"])]
    got = {r["page_id"]: r["text"] for r in html_text.extracted(spark.createDataFrame([x[:3] for x in own], "page_id long, url string, html string")).collect()}
    assert got == {x[0]: "\n".join(x[3]) for x in own}


def test_shared_passage_stays_in_articles(spark):
    said = "A passage that three articles quote"
    pages = [(i, f"http://h.org/a/{i}", page(f"<article><p>{f'Own words of page {i} '.strip() * 9}</p><p>{said}</p></article>")) for i in range(3)]
    got = html_text.extracted(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(got) == 3 and all(r["text"].split("\n")[1:] == [said] for r in got)


def test_pipeline_stages_on_planted_rows(spark):
    rng = random.Random(13)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))
    a, b, item = prose(120), prose(120), prose(30)
    rows = [(1, a, "en", "s", 1), (2, a, "en", "s", 1), (3, b + " " + item, "en", "s", 1), (4, prose(100) + " mail me@site.org now", "de", "s", 1), (5, "short", "en", "s", 1), (6, None, None, None, None), (7, prose(200), "fr", "s", 1)]
    d = spark.createDataFrame([(*r, "x", "y", "z", "v", "u", "t") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, key string, _m string, q string, fp string, pii string, `a.b` string")
    lab = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    import tempfile

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    lab.write.parquet(f"{folder}/labels.parquet")
    bench.write.parquet(f"{folder}/benchmark.parquet")
    left = [{1, 2, 3, 4, 7}, {1, 3, 4, 7}, {1, 4, 7}, {1, 4, 7}, {1, 4, 7}]
    for (name, stage), want in zip(corpus_pipeline.STAGES, left):
        out = corpus_pipeline.written_table(stage(spark, d, folder))
        assert {r["doc_id"] for r in out.collect()} == want and out.count() == len(want), name
        if name == "PII":
            text = {r["doc_id"]: r["text"] for r in out.collect()}
            assert "[EMAIL]" in text[4] and "@" not in text[4] and text[1] == a
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == d.columns
            assert stage(spark, d.limit(0), folder).count() == 0
        d = out


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_pipeline_on_test_tables(spark):
    """Every stage against brute force over its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r["doc_id"] for r in quality.judged(docs, spark.read.parquet(f"{SF}/labels.parquet")).filter("q.kept").select("doc.doc_id").collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in good)
    first = set(slow_groups([(i, simhash.fingerprint(t)) for i, t in rows]).values())
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    known = {tuple(w[i:i + 10]) for _, t in items for w in [words(t)] for i in range(max(1, len(w) - 9)) if w}
    clean = {i for i, t in rows if i in first and not any(tuple(w[k:k + 10]) in known for w in [words(t)] for k in range(len(w)))}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} == clean and len(got) == len(clean)
    assert decontaminate.WINDOW == 10
