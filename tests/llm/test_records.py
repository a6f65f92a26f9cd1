"""WARC, chat, HTML, language, BPE and media operators."""

from __future__ import annotations

import hashlib
import io
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import bpe, chat, html_extract, langid, media, warc
from lexloom.session import table
from tests.conftest import SMALL
from tests.llm.conftest import ODD, clashing

PAGES = "page_id long, url string, html string"


# --- WARC


def test_warc_records(spark):
    big, small = "<p>" + "x" * 200, "tiny"
    rows = [(3, "http://a/b c\r\nd", big), (1, None, big), (2, "u", big), (9, "u", small), (8, "u", small), (7, "u", None), (6, "u", ""), (None, "u", big), (1, None, big), (5, "u", "é" * 60)]
    rows += [(10 + i, "http://h/%d" % i, "<html>" + str(i) * 500) for i in range(50)]
    pages = clashing(spark.createDataFrame(rows, PAGES))
    archives = warc.write_archives(pages)
    got = sorted(((r.page_id is None, r.page_id or 0), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(archives).collect())
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        revisit = html == big and page != 1
        want.append(((page is None, page or 0), len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", 1 if revisit else None))
    assert got == sorted(want)
    payloads = {r.page_id: r.payload for r in warc.read_archives(archives).collect() if r.record_type == "response"}
    assert bytes(payloads[12]).decode() == rows[12][2]
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_warc_layout_and_random_access(tmp_path, spark):
    import zstandard

    records = [warc.record(i, f"http://a/{i}", (f"body {i} " * 40).encode(), hashlib.sha256((f"body {i} " * 40).encode()).hexdigest(), None) for i in range(200)]
    data = warc.pack(records)
    assert int.from_bytes(data[:4], "little") == 0x184D2A5D
    assert list(warc.unpack(data)) == records
    size = int.from_bytes(data[4:8], "little")
    words = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    assert zstandard.ZstdDecompressor(dict_data=words).decompressobj().decompress(data[8 + size :]) == records[0]
    plain = sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in records)
    assert len(data) - 8 - size < plain
    damaged = bytearray(records[0])
    damaged[-10] ^= 1
    with pytest.raises(ValueError):
        warc.parse(bytes(damaged))
    pages = spark.createDataFrame([(i, "u", "x" * 300 + str(i)) for i in range(20)], PAGES)
    assert warc.export_archives(warc.write_archives(pages), f"file://{tmp_path}/out") >= 1
    files = list((tmp_path / "out").glob("*.warc.zst"))
    assert sum(len(list(warc.unpack(f.read_bytes()))) for f in files) == 20


# --- Chat


@given(st.text(alphabet="<|\\im_end>a \n&"), st.text(alphabet="user\\n<|\n"))
def test_escapes(text, role):
    assert chat.unescape(chat.escape(text)) == text
    assert "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(role)) == role
    assert "\n" not in chat.escape_role(role)
    assert chat.read_back(chat.render([(role, text), ("assistant", text)])[0]) == [(role, text), ("assistant", text)]


def test_align_by_bisection():
    assert chat.align([(0, 2), (2, 5), (5, 6), (6, 6), (6, 9)], [(1, 3), (5, 6), (7, 7), (8, 9)]) == ([0, 1, 2, 4], [(1, 3), (5, 6), (7, 7), (8, 9)])


def test_chat_masks(spark):
    rows = [(1, 0, "user", "hi\n\n"), (1, 1, "assistant", "  漢字😀 <|im_end|> ok\n"), (1, 2, "assistant", ""), (2, 0, None, None), (2, 0, None, None), (3, None, "assistant", "x" * 30000), (None, 1, "assistant", "a"), (None, 0, "user\nx", "b")]
    conversations = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    made = {r.conv_id: r for r in chat.format_conversations(conversations).collect()}
    encoder = chat._tokenizer(chat.default_vocabulary())
    for r in made.values():
        assert len(r.ids) == len(r.mask) and encoder.decode(r.ids, skip_special_tokens=False) == r.formatted
    covered = encoder.decode([i for i, m in zip(made[1].ids, made[1].mask, strict=True) if m])
    assert "漢字😀" in covered and "hi" not in covered
    found = {r.conv_id: r for r in chat.digest(conversations).collect()}
    assert found[1].loss_chars == len(rows[1][3]) and found[1].loss_sha256 == hashlib.sha256(rows[1][3].encode()).hexdigest()
    assert found[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows[:3]).encode()).hexdigest()
    assert found[2].n_turns == 2 and found[2].loss_chars == 0
    assert found[3].loss_chars == 30000
    assert found[None].turns_sha256 == hashlib.sha256(b"user\nx\nb\nassistant\na\n").hexdigest()
    assert found[-1].loss_sha256 == hashlib.sha256(b"<|im_end|><|im_start|>assistant ok").hexdigest() and found[-1].n_turns == 2
    assert [r.conv_id for r in chat.digest(conversations.limit(0)).collect()] == [-1]


@given(st.text(alphabet="ab1 \n\t<|\u00e9\u6f22\U0001f600.'s", max_size=400), st.integers(1, 30))
@settings(max_examples=200, deadline=None)
def test_pieces_encode_as_the_whole(text, most):
    """Cut anywhere that is allowed, ids and offsets are those of one encoding."""
    encoder = chat._tokenizer(chat.default_vocabulary())
    text = chat.render([("user", text), ("assistant", text)])[0]
    whole = encoder.encode(text, add_special_tokens=False)
    ids, offsets = chat.encode(encoder, text, most)
    assert ids.tolist() == whole.ids and [tuple(x) for x in offsets.tolist()] == whole.offsets


def test_long_conversations(spark):
    """One conversation of 12,000 turns, one of a single turn of 4 MB, and short ones between; all as brute force says."""
    word = "lorem ipsum <|im_end|> dolor 漢字 "
    rows = [(5, i, "assistant" if i % 2 else "user", f"{i} " + word * (i % 20)) for i in range(12_000)]
    rows += [(7, 0, "user", "q"), (9, 1, "assistant", "a")] + [(100 + i, 0, "assistant", word) for i in range(50)]
    small = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    huge = spark.range(1).selectExpr("8L as conv_id", "0L as turn", "'assistant' as role", "repeat('word and <|im_start|> ', 180000) as text")
    found = {r.conv_id: r for r in chat.digest(small.unionByName(huge)).collect()}
    told: dict = {}
    for conv, _, role, text in [*rows, (8, 0, "assistant", "word and <|im_start|> " * 180_000)]:
        told.setdefault(conv, []).append((role, text))
    for conv, turns in told.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        r = found[conv]
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in turns).encode()).hexdigest()
        assert r.formatted_chars == sum(len(x) for x in (chat.render([t])[0] for t in turns))
    assert set(found) == {*told, -1}
    whole = chat.format_conversations(small.filter("conv_id = 5")).first()
    turns = told[5]
    assert whole.formatted == chat.render(turns)[0] and len(whole.ids) == len(whole.mask)
    assert "".join(whole.formatted[s.start : s.stop] for s in whole.loss_spans) == "".join(chat.escape(t) for r, t in turns if r == "assistant")


# --- HTML


def page(body: str) -> str:
    return f"<html><head><title>t</title><style>p{{}}</style></head><body>{body}</body></html>"


def test_html_regions():
    source = page(
        "<header><h1>Site</h1></header><nav><ul><li><a href=/>Menu</a></li></ul></nav><div class='cookie-notice'>We use cookies</div>"
        "<div id=sidebar>Side</div><main><article class='post has-sidebar'><header><h1>Title &amp; more</h1></header><div class=share-buttons>Share</div>"
        "<p>One<br>two   <b>bold</b>&nbsp;x<p>Three <a href=x>link</a>.<script>var a='<p>no</p>';</script><!-- c --><ul><li>i1<li>i2</ul>"
        "<form>Sign up</form><aside>Advert</aside><footer>By me</footer><div class='comments'><p>First!</p></div></article></main><footer>&copy;</footer>"
    )
    assert html_extract.extract(source) == "Title & more\n\nShare\n\nOne two bold x\n\nThree link.\n\ni1\n\ni2"
    assert html_extract.extract("plain &lt;text&gt; only") == "plain <text> only"
    assert html_extract.extract("") == ""
    assert html_extract.extract("<p>a<div>b</p>c</div><script>x") == "a\n\nb\n\nc"
    assert html_extract.extract(page("<div class=menu><a>m</a></div><div><p>Body text here</p></div><p><a href=1>only a link here</a></p>")) == "Body text here"
    assert html_extract.extract("<div>" * 5000 + "deep") == "deep"
    assert html_extract.extract("<a b='" * 2000 + "x") is not None


def test_html_wrappers_named_after_neighbours():
    inner = "<article><p>The text.</p><p class=ad>Buy</p></article><div class=sidebar><p>Side</p></div><section id=comments><article><p>First!</p></article></section>"
    assert html_extract.extract(page(f"<div class='content-with-sidebar'>{inner}</div>")) == "The text."
    assert html_extract.extract(page("<article class=ad>Buy</article><article><p>Text</p></article>")) == "Text"
    assert html_extract.extract(page("<div class='layout-sidebar'><p>Only text here</p></div>")) == "Only text here"
    assert html_extract.extract(page("<div class=notice>Notice</div><div id=post><h2>T</h2><p>Body</p></div><div class=comments><p>No</p></div>")) == "T\n\nBody"


def test_article_keeps_links_and_class_words():
    """Inside the article neither link share nor a class word drops text."""
    menu, foot = "<nav><ul><li><a href=/>Menu</a></li></ul></nav>", "<footer>Foot</footer>"
    linked = "<article><p>Text here.</p><p><a href=x>Annual report of the harbour office</a></p></article>"
    assert html_extract.extract(page(menu + linked + foot)) == "Text here.\n\nAnnual report of the harbour office"
    assert html_extract.extract(page(menu + "<article><ul><li><a href=x>One</a></li><li><a href=y>Two</a></li></ul></article>" + foot)) == "One\n\nTwo"
    named = "<article><p>Text.</p><p class='legal'>Law.</p><div class='banner-story'>Story.</div><div class=comments>First!</div></article>"
    assert html_extract.extract(page(menu + named + foot)) == "Text.\n\nLaw.\n\nStory."


def test_hosts_of_link_lists(spark):
    """Articles that are lists of links stay on a host where all are; so does a paragraph that is a link on every page."""
    items = lambda i: "".join(f"<li><a href=/{i}/{j}>item {i} {j}</a></li>" for j in range(9))
    rows = [(i, f"http://l.example/{i}", page(f"<nav><a href=/>Home</a></nav><article><ul>{items(i)}</ul></article>")) for i in range(8)]
    rows += [(20 + i, f"http://p.example/{i}", page(f"<article><p>{f'own{i} ' * 30}</p><p><a href=/{i}>Report {i}</a></p></article>")) for i in range(8)]
    found = _induced(spark, rows)
    assert all(found[i] == "\n\n".join(f"item {i} {j}" for j in range(9)) for i in range(8))
    assert all(found[20 + i].endswith(f"own{i}\n\nReport {i}") for i in range(8))


def best_matching(page_tree, tree):
    """Nodes that a largest matching pairs, equal texts counted once more, by trying every alignment of children."""
    from functools import cache

    @cache
    def lists(x, y):
        if not x or not y:
            return 0
        return max(lists(x[1:], y), lists(x, y[1:]), score(x[0], y[0]) + lists(x[1:], y[1:]) if x[0][0] == y[0][0] else 0)

    def score(x, y):
        return 1 + (x[1] == y[1] != "") + lists(x[2], y[2])

    return score(page_tree, tree)


def shape_of(tree):
    """A tree of (label, text, children) as one of the operator's."""
    source = lambda t: f"<{t[0]}>{t[1]}{''.join(map(source, t[2]))}</{t[0]}>"
    return html_extract.Shape.of(html_extract.Page("".join(map(source, tree[2]))))


def test_tree_matching_against_all_alignments():
    import random

    rng = random.Random(4)

    def tree(depth):
        return (rng.choice(("div", "section", "main")), rng.choice(("", "a", "b")), tuple(tree(depth - 1) for _ in range(rng.randint(0, 3))) if depth else ())

    for _ in range(200):
        a, b = (("#", "", tree(3)[2]) for _ in range(2))
        x, y = shape_of(a), html_extract.Wrapper()
        y.grow(shape_of(b))
        found = y.match(x)
        parent = {c: k for k, own in enumerate(x.children) for c in own}
        above = {c: k for k, own in enumerate(y.children) for c in own}
        assert len(set(found.values())) == len(found) and all(x.labels[i] == y.labels[j] for i, j in found.items())
        assert all(i == 0 or found[parent[i]] == above[j] for i, j in found.items())
        for k in found:
            own = [found[c] for c in x.children[k] if c in found]
            assert own == sorted(own, key=y.children[found[k]].index)
        worth = sum(1 + bool(x.texts[i] and x.texts[i][0] in y.texts[j]) for i, j in found.items())
        assert worth == best_matching(a, b)


def test_wrapper_grows_in_order():
    """What a page has more is put where it stands; the page then matches whole."""
    w = html_extract.Wrapper.grown([html_extract.Page(x) for x in ("<h1>t</h1><p>a</p><p>End</p>", "<h1>u</h1><div>n</div><p>b</p><ul><li>i</ul><p>End</p>", "<p>c</p><p>d</p><p>End</p>")])
    assert [w.labels[k] for k in w.children[0]] == ["h1", "div", "p", "ul", "p", "p"] or [w.labels[k] for k in w.children[0]] == ["h1", "div", "p", "p", "ul", "p"]
    for source in ("<h1>u</h1><div>n</div><p>b</p><ul><li>i</ul><p>End</p>", "<p>c</p><p>d</p><p>End</p>"):
        shape = html_extract.Shape.of(html_extract.Page(source))
        assert len(w.match(shape)) == len(shape.labels)
    again = html_extract.Wrapper.loads(w.dumps())
    assert again.children == w.children and again.texts == w.texts
    assert html_extract.Wrapper.grown([]).match(shape) == {}


def test_alignment_digests_only_what_the_wrapper_can_have_seen(monkeypatch):
    """A text of the page's own costs one digest, its subtrees none, and all nodes get the partners of a full match."""
    pages = ["".join(f"<div class=c><p>own {i} {j}</p><p>{'standing' if j % 5 == 0 else f'new {i} {j}'}</p></div>" for j in range(40 + i)) for i in range(4)]
    w = html_extract.Wrapper.grown([html_extract.Page(x) for x in pages[:3]])
    page = html_extract.Page(pages[3] + "<p>standing</p>")
    whole = w.match(html_extract.Shape.of(page))
    done, number = [], html_extract.number
    monkeypatch.setattr(html_extract, "number", lambda *told: done.append(told) or number(*told))
    page.align(w)
    assert page.slots == [b"w%d" % whole[k] if k in whole else page.slots[k] for k in range(len(page.nodes))]
    assert sum(x.startswith(b"w") for x in page.slots) == len(whole)
    assert len(done) <= len(page.blocks) + 10  # blocks, and the subtrees of standing texts


def test_long_lists_of_children_match_in_order():
    """Beyond the table's bound children pair in order; up to it, standing text finds its place."""
    many = "".join(f"<p>own {j}</p>" for j in range(2300))
    w = html_extract.Wrapper.grown([html_extract.Page(many)])
    other = html_extract.Shape.of(html_extract.Page("<div>x</div>" + many.replace("own", "new")))
    assert len(w.match(other)) == 2301
    w = html_extract.Wrapper.grown([html_extract.Page("<p>a</p><p>House line</p>")])
    found = w.match(html_extract.Shape.of(html_extract.Page("".join(f"<p>z{j}</p>" for j in range(3000)) + "<p>House line</p>")))
    assert w.texts[found[3001]] == w.texts[2]


def test_wrapper_induction(spark):
    """A line that stays on every page is template, though nothing marks it; copies of an article are not."""
    words = [" ".join(f"w{(i * 7 + j * j) % 997}" for j in range(60)) for i in range(30)]
    rows = [(i, f"https://Site.example/{i}", page(f"<div class=c><h1>Title {i}</h1><p>{words[i]}</p><p>Read more of our stories</p></div>")) for i in range(30)]
    copies = [(100 + i, f"http://copies.example/{i}", page(f"<article><p>{words[0]}</p><p>{words[1]}</p></article><!-- {i} -->")) for i in range(12)]
    odd = [(200, None, None), (201, "", "<p>x"), (201, "", "<p>x"), (None, "http://lone.example", page("<p>alone</p>"))]
    pages = clashing(spark.createDataFrame(rows + copies + odd, PAGES))
    for bound in (html_extract.BROADCAST_BYTES, 0):
        found = {}
        for r in html_extract.extract_pages(pages, bound).collect():
            found.setdefault(r.page_id, []).append(r.text)
        for i in range(30):
            assert found[i] == [f"Title {i}\n\n{words[i]}"]
        for i in range(12):
            assert found[100 + i] == [f"{words[0]}\n\n{words[1]}"]
        assert found[200] == [""] and found[201] == ["x", "x"] and found[None] == ["alone"]
    assert html_extract.digest(pages.limit(0)).count() == 0


def _induced(spark, rows):
    return {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(rows, PAGES)).collect()}


def test_induction_of_large_and_deep_pages(spark):
    """Pages of thousands of slots or levels take part in induction like any other."""
    large = "".join(f"<h2>a{{0}} {j}</h2><p>b{{0}} {j}</p>" for j in range(1500))
    deep = "<section>" * 400 + "<p>" + "c{0} " * 30 + "</p>" + "</section>" * 400
    for host, inner in (("large", large), ("deep", deep)):
        rows = [(i, f"http://{host}.example/{i}", page("<p>Standing line of this site</p>" + inner.format(i))) for i in range(8)]
        found = _induced(spark, rows)
        assert all("Standing line" not in found[i] and str(i) in found[i] for i in range(8)), host


def test_long_standing_text_makes_no_copies(spark):
    """A notice longer than the articles is template; pages with the same article count once."""
    notice = "Standing notice of the house about its terms and its hours. " * 7
    rows = [(i, f"http://terms.example/{i}", page(f"<article><p>{notice}</p><p>{f'own{i} ' * 30}</p></article>")) for i in range(8)]
    rows += [(100 + i, f"http://same.example/{i}", page(f"<article><p>{notice}</p><p>{f'own{i % 3} ' * 30}</p></article>")) for i in range(30)]
    found = _induced(spark, rows)
    assert [found[i] for i in range(8)] == [f"own{i} " * 29 + f"own{i}" for i in range(8)]
    assert all(found[100 + i].startswith("Standing notice") for i in range(30))  # three articles are too few


def test_template_of_each_layout(spark):
    """Two layouts in equal shares have templates of their own; one text for both is the host's."""
    rows = []
    for i in range(12):
        own = f"<p>{f'own{i} ' * 30}</p>"
        inner = f"<div class=story><p>Story house line</p>{own}</div>" if i % 2 else f"<section class=brief><div>{own}<p>Brief house line</p></div></section>"
        rows.append((i, f"http://two.example/{i}", page(inner)))
    # A word that is standing text in one layout is content where it is not.
    rows.append((12, "http://two.example/12", page(f"<main><p>Story house line</p><p>{'own12 ' * 30}</p></main>")))
    found = _induced(spark, rows)
    assert [found[i] for i in range(12)] == [" ".join([f"own{i}"] * 30) for i in range(12)]
    assert found[12].startswith("Story house line")


@pytest.mark.parametrize("without", range(8))
def test_template_text_may_miss_on_any_page(spark, without):
    """Standing text is removed whichever one page lacks it or has no text; five empty pages are no evidence."""
    rows = [(i, f"http://h.example/{i}", page(f"<div class=c>{'' if i == without else '<p>House line</p>'}<p>{f'own{i} ' * 30}</p></div>")) for i in range(8)]
    rows += [(20 + i, f"http://h.example/e{i}", "" if i % 2 else None) for i in range(5)]
    found = _induced(spark, rows)
    assert [found[i] for i in range(8)] == [" ".join([f"own{i}"] * 30) for i in range(8)]


def article(source):
    from html import unescape

    inner = source[source.index("<article>") + 9 : source.index("</article>")]
    blocks = [" ".join(unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:h1|p)>", inner)]
    return "\n\n".join(b for b in blocks if b)


def test_induction_decides_without_names(spark):
    """Pages whose boxes are all plain div, with text that varies everywhere: the hosts' pages tell which box it is."""
    from pyspark.sql import functions as F

    pages = table(spark, "/root/testdata/sf0.1", "pages")
    plain = F.regexp_replace(F.regexp_replace("html", "<(/?)(?:article|nav|footer)>", "<$1div>"), '<div class="ad">', "<div>")
    wanted = {r.page_id: article(r.html) for r in pages.collect()}
    wrong = {}
    for induced in (True, False):
        got = html_extract.extract_pages(pages.withColumn("html", plain), induced=induced).collect()
        wrong[induced] = sum(r.text != wanted[r.page_id] for r in got)
    assert wrong[False] > 50 and wrong[True] == 0, wrong


def test_wrapper_of_a_host(spark):
    """The slot that most pages propose wins where a page's own notice is longer; menus are told by their links."""
    rows = []
    for i in range(20):
        story = " ".join(f"s{i}x{j}" for j in range(4 if i % 5 == 0 else 60))
        side = " ".join(f"n{i}x{j}" for j in range(30))
        menu = "".join(f"<li><a href=/{i}/{j}>link {i} {j}</a></li>" for j in range(9))
        rows.append((i, f"http://w.example/{i}", page(f"<div><ul>{menu}</ul></div><div>{side}</div><div><h2>Head {i}</h2><p>{story}</p><ul>{menu}</ul></div>")))
    found = _induced(spark, rows)
    for i in range(20):
        assert found[i] == f"Head {i}\n\n" + " ".join(f"s{i}x{j}" for j in range(4 if i % 5 == 0 else 60))


def test_hosts_in_salted_parts(spark):
    """Past the bound of broadcasts a host is dealt over parts, with the same rows."""
    pages = table(spark, SMALL, "pages")
    one = {r.page_id: r.text for r in html_extract.extract_pages(pages).collect()}
    assert {r.page_id: r.text for r in html_extract.extract_pages(pages, 0).collect()} == one


def test_html_wrapper_counts_all_pages(spark):
    """Each of eight layouts of five pages in 400 is in the host's wrapper, with as many paragraphs as any page has; no page is picked by chance."""
    def source(k: int) -> str:
        odd = f"<section class=odd{'abcdefgh'[k // 50]}>" + "<p>x</p>" * (k % 50 + 1) + "</section>" if k % 50 < 5 else ""
        return page(f"<div class=menu>Menu</div>{odd}<article><p>Text {k}</p></article>")

    rows = [(k, f"http://h/{k}", source(k)) for k in range(400)] + [(500 + k, f"http://few/{k % 3}", page(f"<p>{k % 3}</p>")) for k in range(9)]
    pages = spark.createDataFrame(rows, PAGES)
    told = {r.host: html_extract.Wrapper.loads(r.shape) for r in html_extract.shapes(pages).collect()}
    assert set(told) == {"h"}  # the other host has three different pages
    found = {told["h"].labels[k]: len(c) for k, c in enumerate(told["h"].children) if told["h"].labels[k].startswith("section")}
    assert found == {f"section.odd{x}": 5 for x in "abcdefgh"}
    assert html_extract.exemplars(pages).filter("host = 'h'").count() <= 20


def test_html_against_plain_parser(spark):
    pages = table(spark, SMALL, "pages")
    wanted = {r.page_id: article(r.html) for r in pages.collect()}
    got = html_extract.digest(pages).collect()
    assert {r.page_id: r.text for r in got} == wanted
    assert all(r.n_chars == len(r.text) for r in got)


# --- Language


def greedy_phrases(reference: str, text: str) -> int:
    count = at = 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at : end + 1] in reference:
            end += 1
        count, at = count + 1, end
    return count


def test_phrases_match_greedy_parsing():
    samples = (("a", ("banana bandana",)), ("b", ("cocoa coco nut",)))
    parser = langid.Parser(samples)
    for text in ("banana", "bancocoa", "nut", "zzz ban", "coco nut banana", "b"):
        got = parser.phrases([parser.symbols(text)])[:, 0].tolist()
        assert got == [greedy_phrases(s[0], text) for _, s in samples], text


def test_phrases_of_long_and_many_texts():
    """Walked together or singly, phrases of any length are those of the plain greedy parsing."""
    import random

    rng = random.Random(3)
    reference = "".join(rng.choice("abcdefgh ") for _ in range(2000)).strip()
    other = "".join(rng.choice("abcxyz ") for _ in range(1500)).strip()
    parser = langid.Parser((("a", (reference,)), ("b", (other,))))
    texts = [reference[:900] + other[:900], reference * 2, other[100:1400], "q" * 300] + [reference[i : i + 40 + i] for i in range(60)]
    texts = [" ".join(t.split()) for t in texts]
    want = [[greedy_phrases(" ".join(s.split()), t) for s in (reference, other)] for t in texts]
    for some in (texts, texts[:5], texts[1:2]):
        assert parser.phrases([parser.symbols(t) for t in some]).T.tolist() == [want[texts.index(t)] for t in some]
    assert parser.phrases([parser.symbols(" ".join(reference.split()))])[0, 0] == 1


def test_language_sample_is_bounded(make_docs):
    """One id repeated many times is one document of the sample."""
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 3 != 1]
    docs = make_docs([f"der hund {i} " + "x" * (i % 7) for i in range(3000)] + ["die katze im haus " * 40] * 500 + ["the dog"] * 3, ids=ids[:1] * 3000 + ids[1:2] * 500 + ids[2:5], langs=["de"] * 3500 + ["en"] * 3)
    samples = langid.learn(docs)
    assert set(samples) == {"de", "en"} and all(len(t) <= langid.DOCUMENTS for t in samples.values())


@pytest.mark.parametrize("name", ["documents"])
def test_language_against_plain_parsing(spark, name):
    """Predictions on a whole table, by substring search instead of automata."""
    import math

    docs = table(spark, SMALL, name).filter("length(text) < 3000")
    samples = langid.learn(docs)
    parser = langid.Parser(tuple((n, tuple(samples[n])) for n in sorted(samples)))
    back = lambda symbols: "".join(chr(0x100 + s) for s in symbols.tolist())
    references = {}
    for n in sorted(samples):
        whole = np.concatenate([parser.symbols(t) for t in samples[n]])
        references[n] = (back(whole), math.log2(len(whole)))
    got = {r.doc_id: r for r in langid.digest(docs).collect()}
    for r in docs.collect():
        text = back(parser.symbols(r.text)) if r.text else ""
        if got[r.doc_id].lang_pred == "und":
            continue
        cost = {n: greedy_phrases(ref, text) * bits for n, (ref, bits) in references.items()}
        assert cost[got[r.doc_id].lang_pred] == min(cost.values())


def test_scripts_of_many_letters():
    """Languages that differ in letters beyond the frequent ones only; phrases as in the plain greedy parsing."""
    import random

    letters = [[chr(0x4E00 + 200 * n + j) for j in range(200)] for n in range(3)]
    rng = random.Random(5)
    write = lambda own, n: "".join(rng.choice(own) + rng.choice(("", "", " ")) for _ in range(n))
    samples = tuple((f"l{n}", (write(own, 3000),)) for n, own in enumerate(letters))
    parser = langid.Parser(samples)
    texts = [write(own, 80) for own in letters] + [write(letters[0] + letters[2], 80)]
    assert parser.predict(texts[:3])[0] == ["l0", "l1", "l2"]
    for text in texts:
        got = parser.phrases([parser.symbols(text)])[:, 0].tolist()
        assert got == [greedy_phrases(" ".join(s[0].split()), text) for _, s in samples]


def test_language_of_long_documents_only(make_docs):
    docs = make_docs(["der hund und die katze " * 4000, "der hund und die maus " * 4000, "the dog and the cat"] * 4, langs=["de", "de", "en"] * 4)
    samples = langid.learn(docs)
    assert samples == {"de": ["der hund und die katze " * 4000], "en": ["the dog and the cat"]} or samples == {"de": ["der hund und die maus " * 4000], "en": ["the dog and the cat"]}
    more = learned_beside(make_docs, "der wolf " * 100)
    assert more == ["der wolf " * 100]


def learned_beside(make_docs, text):
    """What is learned where one document is within the bound and one is beyond it."""
    ids = [i for i in range(9) if zlib.crc32(str(i).encode()) % 3 != 1]
    return langid.learn(make_docs(["der hund " * 9000, text], ids=ids[:2], langs=["de", "de"]))["de"]


def test_language_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    told = {r.doc_id: r for r in langid.digest(docs).collect()}
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [i for i, r in told.items() if r.held_out]
    assert {i for i in told if zlib.crc32(str(i).encode()) % 3 == 1} == set(held)
    assert sum(told[i].lang_pred == lang[i] for i in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in told.values())


def test_language_odd_rows(make_docs):
    texts = [*ODD, "123 !!", "der hund und die katze", "the dog and the cat"]
    docs = make_docs(texts, langs=["en"] * (len(texts) - 2) + ["de", None])
    rows = {r.doc_id: r for r in langid.digest(clashing(docs)).collect()}
    assert len(rows) == len(texts)
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (0, 1, 2, 11, len(texts) - 3))
    assert rows[9].lang_pred == rows[10].lang_pred and rows[9].score == rows[10].score
    unlabelled = make_docs(["some words"], langs=[None])
    assert [r.lang_pred for r in langid.digest(unlabelled).collect()] == ["und"]
    assert langid.digest(docs.limit(0)).count() == 0


# --- BPE


@pytest.fixture(scope="module")
def codecs():
    import tiktoken

    path, pattern = bpe.public_vocabulary()
    own = bpe.codec(path, pattern)
    return own, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=own.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=60))
def test_bpe_as_rank_merging(codecs, text):
    own, other = codecs
    assert own.encode(text) == other.encode_ordinary(text)
    assert own.decode(own.encode(text)) == text.encode()


def test_bpe_columns(make_docs, codecs):
    texts = [t for t in ODD]
    docs = clashing(make_docs(texts))
    for r in bpe.digest(docs).collect():
        ids = codecs[1].encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs)).select("doc_id", "bytes").collect()
    assert all(bytes(r.bytes) == (texts[r.doc_id] or "").encode() for r in back)
    assert bpe.digest(docs.limit(0)).count() == 0


def test_bpe_needs_dense_ranks():
    with pytest.raises(ValueError):
        bpe.serialise({b"a": 0, b"b": 2})


# --- Media


def test_stored_texts(make_docs):
    texts = [*ODD, "x" * 575, "x" * 576, "x" * 577]
    for r in media.digest(clashing(make_docs(texts))).collect():
        data = (texts[r.doc_id] or "").encode()
        payload = data.ljust(max(1, -(-len(data) // 576)) * 576, b"\xff")
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
        stored = media.store_text(texts[r.doc_id])
        tile = np.load(io.BytesIO(bytes(r.npy)))
        assert tile.shape == (32, 32) and (tile == np.load(io.BytesIO(media.npy_tile(media.grey(media.decode(stored)))))).all()
        assert r.media_bytes == len(stored) and r.media_sha256 == hashlib.sha256(stored).hexdigest()
    assert media.digest(make_docs([])).count() == 0


def test_decoders():
    grey = np.arange(12, dtype=np.uint8).reshape(3, 4)
    assert (media.decode(b"P5 # c\n4 3\n255\n" + grey.tobytes())[:, :, 0] == grey).all()
    assert (media.decode(b"P2\n4 3\n255\n" + b" ".join(str(x).encode() for x in grey.ravel()))[:, :, 0] == grey).all()
    assert media.decode(b"P4\n3 2\n\xa0\x40")[:, :, 0].tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P1\n3 2\n101\n0 1 0")[:, :, 0].tolist() == [[0, 255, 0], [255, 0, 255]]
    wide = media.decode(b"P5\n1 1\n65535\n\x01\x02")
    assert wide[0, 0, 0] == 258
    rgb = np.random.default_rng(1).integers(0, 256, (5, 7, 3), dtype=np.uint8)
    assert (media.decode(media.encode_bmp(rgb)) == rgb).all() and (media.decode(media.encode_ppm(rgb)) == rgb).all()
    for bad in (b"", b"P9", b"BM", b"P5\n4 3\n255\nxx"):
        with pytest.raises(Exception):
            media.decode(bad)


def test_area_resize():
    plane = np.random.default_rng(2).random((12, 18))
    assert np.allclose(media.area_resize(plane, 4, 6), plane.reshape(4, 3, 6, 3).mean(axis=(1, 3)))
    fine = np.kron(plane, np.ones((5, 7)))
    assert np.allclose(media.area_resize(plane, 5, 7), fine.reshape(5, 12, 7, 18).mean(axis=(1, 3)))


def test_tiles(spark):
    rgb = np.random.default_rng(3).integers(0, 256, (40, 50, 3), dtype=np.uint8)
    df = spark.createDataFrame([(1, bytearray(media.encode_bmp(rgb))), (2, bytearray(media.encode_ppm(rgb))), (3, bytearray(b"no")), (4, None)], "id int, media binary")
    rows = {r.id: r for r in media.tiles(df).collect()}
    assert rows[1].dhash == rows[2].dhash and (rows[1].width, rows[1].height) == (50, 40)
    assert np.load(io.BytesIO(bytes(rows[1].npy))).shape == (32, 32)
    assert rows[3].dhash is None and rows[4].npy is None
