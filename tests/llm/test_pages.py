import hashlib
import re
from html import unescape

import numpy as np
import pytest
import zstandard

from lattiq.llm import html, warc
from lattiq.llm.common import load

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string"
ARTICLE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "<p>no</p>";</script><style>p{}</style></head><body>
<header class="site">Site name</header><nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies</div>
<article><header><h1>Head &amp; line</h1><span>by X</span></header><p>First   para<b>graph</b>,<br>two lines.<p>Second &eacute;&nbsp;one &lt;b&gt;.
<ul><li>item 1<li>item 2</ul><aside>see also</aside><form><input value="x">sign up</form><div class="ad">buy</div>
<section id="comments"><p>nice post</p></section></article><div id="sidebar">side</div><footer>&copy; me</footer></body></html>"""


def test_main_text_rules():
    want = "Head & line\nFirst paragraph, two lines.\nSecond é one <b>.\nitem 1\nitem 2"
    assert html.main_text(ARTICLE) == want
    assert html.main_text("") == "" and html.main_text("plain  text &amp; more") == "plain text & more"
    assert html.main_text("<p>a<!-- b --><script>c") == "a"
    assert html.main_text("<div hidden>x</div><p style='display:none'>y</p><p>z</p>") == "z"
    assert html.main_text("<p>broken <a href='x>y</p><p>z") == "broken y\nz"
    assert html.main_text("<p title=it's>one</p><p data-x='a > b' id=q>two</p><p>it's</p>") == "one\ntwo\nit's"
    assert html.main_text("a < b and c > d") == "a < b and c > d"


def test_names_vote_and_text_overrules():
    for name in ("layout has-sidebar", "no-sidebar", "with-nav", "layout sidebar"):
        assert html.main_text(f'<div class="{name}"><article><p>story</p></article></div>') == "story"
    inner = '<div class="post-header"><h1>Head</h1></div><h2 id="related-work">Work</h2><section id="discussion"><p>We discuss</p></section><p class="share-price">Price 5</p><div id="survey-results">Results</div>'
    assert html.main_text(f'<article>{inner}<div class="share-buttons"><a href=x>Tweet</a></div><div class="ad">buy</div></article>') == "Head\nWork\nWe discuss\nPrice 5\nResults"
    assert html.main_text("<p>a <math><mi>x</mi><mo>=</mo><mn>2</mn></math> b</p><svg/><p>c<math/></p><p>d</p>") == "a x=2 b\nc\nd"
    assert html.main_text('<div class="sidebar">links</div><div class="story">text</div>') == "text"


def test_the_largest_region_is_the_main_text(spark):
    story = "a long story of many words " * 8
    for name in ("card", "comment"):
        assert html.main_text(f'<main><p>{story}</p><article class="{name}"><p>short</p></article></main>') == story.strip()
    assert html.main_text(f"<main><h1>Title</h1><article><p>{story}</p></article></main>") == story.strip()
    page = '<body><div class="story"><h2>{0}</h2><p>{0} {1}</p></div><article class="card"><p>Teaser {0}</p></article></body>'
    df = spark.createDataFrame([(k, "http://h.example/x", page.format(t, story)) for k, t in enumerate("abcdef")], PAGES)
    for r in html.extract(df).collect():
        assert r["text"].endswith(story.strip()) and "Teaser" not in r["text"]


def test_generated_pages(spark):
    pages = load(spark, SF, "pages")
    got = {r["page_id"]: r for r in html.extract(pages).collect()}
    for r in pages.collect():
        inner = re.sub(r"</?b>", "", re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]).replace("<br>", " ")
        blocks = [" ".join(unescape(x).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        want = "\n".join(x for x in blocks if x)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_wrapper_of_a_host(spark):
    page = "<html><body><div class=top>Same slogan</div><div class=body><h2>{0}</h2><p>{0} one {1}</p>{2}</div></body></html>"
    texts = ["alpha", "beta", "gamma", "delta", "eps", "zeta"]
    rows = [(k, "http://h.example/x", page.format(t, "long text " * (k + 3), f"<p>{t} two</p>" * (k % 3))) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, PAGES)
    import json

    w = json.loads(html.wrappers(df).first()["wrapper"])
    shown = html.render(w)
    assert '"Same slogan"' in shown and "(<p> #TEXT </p>)+" in shown and "<h2> #TEXT </h2>" in shown
    got = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    for k, t in enumerate(texts):
        assert got[k].split("\n")[0] == t and "slogan" not in got[k] and got[k].count("two") == k % 3


def test_alignment_makes_optional_and_repeated_groups():
    tree = lambda s: html.fold(html.Page(s).tree)
    w = html.unite(tree("<div><h1>a</h1><p>x</p></div>"), tree("<div><p>x</p><p>y</p><hr><table></table></div>"))
    shown = html.render(w)
    assert '(<h1> "a" </h1>)?' in shown and "(<p> #TEXT </p>)+" in shown and "(<table> </table>)?" in shown
    assert "(<dt> #TEXT </dt> <dd> #TEXT </dd>)+" in html.render(tree("<dl><dt>a<dd>1<dt>b<dd>2<dt>c<dd>3</dl>"))


def test_extract_odd_rows(spark):
    rows = [(1, None, None), (2, "", ""), (None, "http://a.b/c", "<p>x"), (3, "odd url", "<p>y</p>"), (3, "odd url", "<p>y</p>"), (4, "http://a.b/", "<article><p>" + "long word " * 60_000)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, PAGES).withColumn("text", F.lit("clash")).withColumn("host", F.lit("clash")).withColumn("rule", F.lit("clash"))
    got = html.extract(df).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == [(0, 1), (1, 0), (2, 0), (3, 1), (3, 1), (4, 599_999)]
    assert html.extract(spark.createDataFrame([], PAGES)).collect() == []


def test_copies_of_a_page_make_no_template(spark):
    page = "<html><body><div><h2>A short heading</h2><p>" + "a long block " * 40 + "</p><pre>A short line</pre></div></body></html>"
    df = spark.createDataFrame([(k, "http://copies.example/x", page) for k in range(12)], PAGES).repartition(12)
    for r in html.extract(df).collect():
        assert r["text"].startswith("A short heading\n") and r["text"].endswith("\nA short line")


def _plain_host(host, k):
    """A page without article, main or telling names: the place of its text is known from the host's other pages alone."""
    rnd = np.random.default_rng([len(host), k])
    word = lambda n: " ".join(rnd.choice([f"{host[0]}word{j}" for j in range(900)], n))
    story = [word(int(rnd.integers(20, 60))) for _ in range(int(rnd.integers(3, 7)))]
    teasers = "".join(f"<div class=t{j}><b>{word(3)}</b></div>" for j in range(int(rnd.integers(1, 5))))
    body = "".join(f"<p>{x}</p>" for x in story)
    page = f"<html><body><div class=a1><div>{host} home of stories and more</div><div>All the sections of {host}</div></div><div class=b{k}><h1>Story {k}</h1>{body}</div><div class=c>{teasers}</div><div class=d>Printed by {host}, all rights kept</div></body></html>"
    return page, "\n".join([f"Story {k}", *story])


def test_wrappers_place_the_text_where_no_tag_does(spark):
    rows, want = [], {}
    for h in range(6):
        for k in range(9):
            page, text = _plain_host(f"{'abcdef'[h]}host", k)
            rows.append((10 * h + k, f"http://{'abcdef'[h]}host/{k}", page))
            want[10 * h + k] = text
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == want
    assert all(html.main_text(page, None) != want[i] for i, _, page in rows)  # a page alone does not show it


def test_deep_and_wide_pages(spark):
    wide = "".join(f"<div class='k{'abcdefg'[k % 7]}{'xyz'[k % 11 % 3]}'><p>text {'n' * (k % 5)} {k}</p></div>" for k in range(20_000))
    rows = [
        (1, "http://d/1", "<div>" * 10_000 + "hello"),
        (2, "http://d/2", "<div>" * 5_000 + "<p>one<p>two" + "</div>" * 5_000),
        (3, "http://d/3", "<odd>" * 10_000 + "x" + "</odd>" * 10_000),
        (4, "http://d/4", "<div class=widget>" * 3_000 + "deep"),
        (5, "http://w/1", f"<body>{wide}</body>"),
        (6, "http://w/2", f"<body><i>first</i>{wide[40:]}</body>"),
    ]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert [got[k] for k in (1, 2, 3, 4)] == ["hello", "one\ntwo", "x", "deep"]
    assert got[5].count("\n") == 19_999 and got[5].startswith("text 0\ntext n 1\n")


def test_nearby_matches_are_a_common_subsequence(monkeypatch):
    rng = np.random.default_rng(0)
    a = [str(x) for x in rng.integers(0, 12, 300)]
    b = [x for x in a if rng.random() > 0.1] + ["z"] * 5
    for cells in (1 << 30, 0):
        monkeypatch.setattr(html, "ALIGN_CELLS", cells)
        pairs = html._matches(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) >= (len(b) - 5 if cells else 0.6 * len(b))
    many = [[f"k{k}", False, False, 1, k, None, []] for k in range(2 * html.MAX_KIDS)]
    united = html.align(many, [["other", False, False, 1, 9, None, []], *many[::-1]])
    assert len(united) <= html.MAX_KIDS and sum(x[4] for x in united) == 2 * sum(x[4] for x in many) + 9


def _pages(spark):
    big, other = "<p>" + "same page " * 200, "<p>" + "other page ü " * 150
    rows = [(1, "http://a/ü b", big), (2, "http://b", big), (3, "http://c", big), (4, "u", other), (5, "u", "tiny"), (6, "u", "tiny"), (7, None, None), (8, "u", ""), (9, "u", other), (9, "u", other), (10, "u", "x" * 300_000), (None, "u", big)]
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, PAGES).withColumn("turn", F.lit("clash")).withColumn("payload_bytes", F.lit("clash")), rows


def test_archives_round_trip(spark):
    df, rows = _pages(spark)
    path = warc.write_archives(df)
    got = warc.read_archives(spark, path, with_payload=True).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append(r)
    for i, _, h in rows:
        raw = (h or "").encode()
        assert all(r["payload_bytes"] == len(raw) and r["payload_digest"] == hashlib.sha1(raw).hexdigest() for r in by[i])
        assert all(r["record_type"] == "revisit" or bytes(r["payload"]) == raw for r in by[i])
    kinds = {i: sorted((r["record_type"], r["refers_to"]) for r in v) for i, v in by.items()}
    assert kinds[1] == kinds[2] == [("revisit", 3)] and kinds[3] == [("response", None)]
    assert kinds[4] == [("revisit", 9)] and sorted(k for k, _ in kinds[9]) == ["response", "revisit"]
    assert kinds[5] == kinds[6] == kinds[7] == kinds[8] == [("response", None)]
    raw = bytes(spark.read.format("binaryFile").load(path).orderBy("path").first()["content"])
    magic = [m for m, _, _ in warc.frames(raw)]
    assert magic[0] == warc.DICT_MAGIC and warc.FRAME_MAGIC in magic


def test_archives_empty(spark):
    path = warc.write_archives(spark.createDataFrame([], PAGES))
    assert warc.read_archives(spark, path).collect() == []


def _archive(records, dictionary=None):
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    c = zstandard.ZstdCompressor(dict_data=d)
    head = warc.DICT_MAGIC.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary if dictionary else b""
    return head + b"".join(c.compress(r) for r in records)


def test_reader_rejects_what_is_not_well_formed():
    good = warc.record(1, "http://a", b"hello", 5, hashlib.sha1(b"hello").hexdigest(), None)
    assert next(warc.read_archive(_archive([good])))["payload"] == b"hello"
    assert [r["payload"] for r in warc.read_archive(_archive([good, good], b"WARC-Type: response " * 20))] == [b"hello"] * 2
    packed = zstandard.ZstdCompressor().compress(b"WARC-Type: response " * 20)
    whole = warc.DICT_MAGIC.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed + _archive([good], b"WARC-Type: response " * 20)[8 + 400 :]
    assert next(warc.read_archive(whole))["payload"] == b"hello"
    for bad in (good.replace(b"hello", b"hullo"), good[:-1], good.replace(b"WARC/1.1", b"WARC/9"), re.sub(rb"Content-Length: \d+", b"Content-Length: 9", good, count=1), good.replace(b"WARC-Date", b"X-Date"), good + b"x"):
        with pytest.raises(ValueError):
            list(warc.read_archive(_archive([bad])))
    with pytest.raises(ValueError):
        list(warc.read_archive(_archive([good])[:-2]))
    with pytest.raises(ValueError):
        list(warc.read_archive(b"not an archive"))
