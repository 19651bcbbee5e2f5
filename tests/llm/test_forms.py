"""Tokens, pages, training order and quotations: exact comparisons and odd rows."""

import base64
import hashlib
import random
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from hotspark.llm import bpe, layout, order, queries, quotes

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tree_reduction_equals_plain_merges(plain):
    coder = bpe.Encoder(bpe.read_ranks(PATH))
    rnd = random.Random(1)
    for _ in range(1500):
        letters = rnd.choice(["a", "ab", "the in", "aA .", "éüö ", "0123", "=-", "abcdefghij ", "\u0000日"])
        piece = "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 300))).encode()
        got = coder.encode(piece)
        assert got == plain._encode_single_piece(piece)
        cut = rnd.randrange(len(piece) + 1)
        assert coder.join(coder.encode(piece[:cut]), coder.encode(piece[cut:])) == got


def test_bpe_of_the_table(spark, sf, plain):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = queries.Q["op5_byte_bpe"](spark, sf).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = plain.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_bpe_of_odd_rows_and_back(spark, plain):
    texts = [None, "", " ", "x" * 100_000, "don't \n\n  stop", "<|endoftext|>", "日本語 ñ\u0000", "same", "same"]
    df = spark.createDataFrame([(i, t, -1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    out = bpe.encode(df, PATH, public_tokenizers.PATTERN)
    back = {r.doc_id: r for r in bpe.decode(out, PATH, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        assert back[i].ids == plain.encode_ordinary(t or "") and back[i].text == (t or "")
    assert bpe.encode(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><body><h1>Head &amp; more</h1><p>One <b>two</b>
 three<p>Four<br>five<div hidden>no</div><div style="color:red; display: none">no<p>no</div><ul><li>a<li>b<ol start=3><li>x
<li>y</ol><li>c</ul><table><caption>Cap</caption><tr><th>Name<th>Qty<tr><td>apple pie<td>2<tr><td colspan=2>wide<tr><td rowspan=2>a<br>b<td>7<tr><td>8</table>
<pre>  keep
   this</pre><blockquote>quote<p>more</blockquote>end <!-- c > --><script>if (a<b) "</p>"</script>of <i>text</i>.<dl><dt>T<dd>D</dl>a < b</body></html>"""


def test_layout_of_a_page():
    assert layout.render(PAGE).split("\n") == [
        "Head & more", "", "One two three", "", "Four", "five", "", "- a", "- b", "  3. x", "  4. y", "- c", "", "Cap", "Name       Qty", "apple pie  2", "wide",
        "a          7", "b", "           8", "", "  keep", "   this", "", "  quote", "", "  more", "", "end of text.", "", "T", "  D", "", "a < b",
    ]


def test_cells_stand_where_a_plain_grid_puts_them():
    """Cells that cover several rows and columns, against an occupied-cells grid."""
    rng = random.Random(8)
    for _ in range(300):
        taken, html_, want, n = {}, "<table>", [], 0
        for r in range(rng.randrange(1, 6)):
            html_ += "<tr>"
            at = 0
            for _ in range(rng.randrange(1, 5)):
                across, down = rng.choice([1, 1, 1, 2, 3]), rng.choice([1, 1, 1, 2, 3])
                while taken.get((r, at)):
                    at += 1
                for a in range(across):
                    for d in range(1, down):
                        taken[r + d, at + a] = True
                name = f"c{n}" + "x" * rng.randrange(9)
                html_ += f"<td colspan={across} rowspan={down}>{name}"
                want.append((r, at, name))
                at, n = at + across, n + 1
        lines = layout.render(html_ + "</table>").split("\n")
        place = {}
        for r, at, name in want:
            assert lines[r].split().count(name) == 1
            assert place.setdefault(at, lines[r].index(name)) == lines[r].index(name), (html_, lines)
        order = [place[c] for c in sorted(place)]
        assert order == sorted(set(order))


def test_layout_of_wide_cells_and_visibility():
    wide = "y" * 60
    assert layout.render(f"<table><tr><td>{wide}<td>q<tr><td>a<td>b</table>").split("\n") == [f"{wide}  q", "a" + " " * 61 + "b"]
    assert layout.render("<table><tr><td>A<td rowspan=2>B<tr><td>C<tr><td>D<td>E</table>").split("\n") == ["A  B", "C", "D  E"]
    assert layout.render("<table><tr><td rowspan=70000>A<td>B" + "<tr><td>C" * 2000 + "</table>").split("\n") == ["A  B"] + ["   C"] * 2000
    assert layout.render("<div style='visibility:hidden'>x <p style='visibility: visible'>y<b style='visibility:collapse'>n</b></p> w</div>z") == "y\n\nz"
    assert layout.render("<p style='display:none'><b style='visibility:visible'>x</b></p><p style='display:none; display:block'>y") == "y"


class _Visible(HTMLParser):
    """Words of a page outside script, style and head."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.off, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style", "head", "noscript", "template")
        if tag in layout.BLOCKS or tag in ("br", "td", "th", "tr"):
            self.parts.append(" ")

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style", "head", "noscript", "template") and self.off > 0
        if tag in layout.BLOCKS or tag in ("td", "th", "tr"):
            self.parts.append(" ")

    def handle_data(self, data):
        if not self.off:
            self.parts.append(data)


def _words(text):
    return [w for w in text.split() if w != "-" and not w.rstrip(".").isdigit()]


def test_layout_keeps_the_visible_words_of_the_table(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = queries.Q["op6_html_layout"](spark, sf).collect()
    assert len(out) == len(pages)
    for r in out:
        plain = _Visible()
        plain.feed(pages[r.page_id])
        plain.close()
        if "hidden" not in pages[r.page_id] and "display" not in pages[r.page_id]:
            assert _words(r.text) == _words("".join(plain.parts)), r.page_id


def test_layout_of_odd_rows(spark):
    deep = "<div>" * 50_000 + "x" + "</div>" * 50_000
    pages = [None, "", "plain a < b &amp; c", "<", "<p", "<!--", "<script>x", "</p>", deep, "<table><td>a<table><tr><td>b</table><td>c", "<li>" * 3000, "<p a='" * 2000, "<table>" * 800 + "z", "<td>x", "a b", "<p>s", "<p>s"]
    df = spark.createDataFrame([(i, p, "old") for i, p in enumerate(pages)], "page_id long, html string, text string")
    got = {r.page_id: r.text for r in layout.extract(df).collect()}
    assert len(got) == len(pages)
    assert [got[i] for i in range(9)] == ["", "", "plain a < b & c", "<", "", "", "", "", "x"]
    assert got[9] == "a  c\nb"
    assert got[12] == "z" and got[13] == "x" and got[14] == "a b" and got[15] == got[16] == "s"
    assert layout.extract(df.limit(0)).count() == 0


def test_feistel_takes_every_place_once():
    for size in (1, 2, 3, 5, 16, 17, 1000, 4097):
        got = order.feistel(np.arange(size), size, 9)
        assert sorted(got.tolist()) == list(range(size))
    assert (order.feistel(np.arange(1000), 1000, 1) != order.feistel(np.arange(1000), 1000, 2)).any()


def test_training_order_round_trip(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    path = f"file://{tmp_path}/order"
    out = order.write(docs, "doc_id", "text", path=path, length=100, shard=500).collect()
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    assert sorted(r.slot for r in out) == list(range(sum(-(-len(t) // 100) for t in texts.values())))
    records = order.read(path, 0, len(out) + 5, length=100, shard=500)
    assert len(records) == len(out)
    whole = {}
    for r in out:
        raw = records[r.slot].tobytes()
        assert (r.n_tokens, r.ids_sha256, r.shard) == (len(raw), hashlib.sha256(raw).hexdigest(), r.slot // 500)
        whole.setdefault(r.doc_id, {})[r.part] = raw
    assert {d: b"".join(p[k] for k in sorted(p)) for d, p in whole.items()} == texts
    some = order.read(path, 700, 3, length=100, shard=500)
    assert [a.tolist() for a in some] == [a.tolist() for a in records[700:703]]


def test_training_order_of_odd_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 300, 7]), (2, None), (3, []), (None, [5]), (4, [9]), (4, [9])], "slot long, ids array<int>")
    path = f"file://{tmp_path}/ids"
    out = order.write(df, "slot", "ids", path=path, length=2, shard=3, kind="u2").toPandas()
    assert len(out) == 5 and sorted(out.iloc[:, 0]) == list(range(5))
    assert sorted(tuple(a.tolist()) for a in order.read(path, 0, 9, length=2, shard=3, kind="u2")) == [(1, 300), (5,), (7,), (9,), (9,)]
    assert order.write(df.limit(0), "slot", "ids", path=f"file://{tmp_path}/none").count() == 0


def test_quotation_links(spark):
    a, b, c = "First message\nof two  lines.", "Second, with a point.\n\nAnd more.", "Third."
    mails = [
        ("m", 1, a),
        ("m", 2, b + "\n\nOn Monday Ann wrote:\n> " + a.replace("\n", "\n> ")),
        ("m", 3, ">> first   MESSAGE\n>> of two lines.\n> Second, with a point.\n" + c),
        ("m", 4, a),
        ("m", 5, "> unknown text\nalone"),
        ("n", 1, "> Third.\nother box"),
        ("m", 6, "Sixth\n> Third.\n> > > Second, with a point.\nends"),
        (None, 1, "> x\ny"), ("m", None, None), ("z", 1, None), ("m", 1, a), ("z", 2, "> \n>> "),
    ]
    df = spark.createDataFrame([(*r, 3) for r in mails], "box string, msg int, body string, root int")
    got = {(r["box"], r["msg"]): (r.own, r.n_quotes, r.n_linked, r.parent, r.root, r.depth) for r in quotes.link(df, "box", "msg", "body").collect()}
    assert got == {
        ("m", 1): (a, 0, 0, None, 1, 0), ("m", 2): (b, 1, 1, 1, 1, 1), ("m", 3): (c, 2, 2, 2, 1, 2), ("m", 4): (a, 0, 0, None, 4, 0),
        ("m", 5): ("alone", 1, 0, None, 5, 0), ("n", 1): ("other box", 1, 0, None, 1, 0), ("m", 6): ("Sixth\nends", 2, 2, 3, 1, 3),
        (None, 1): ("y", 1, 0, None, 1, 0), ("m", None): ("", 0, 0, None, None, 0), ("z", 1): ("", 0, 0, None, 1, 0), ("z", 2): ("", 2, 0, None, 2, 0),
    }
    assert quotes.link(df.limit(0), "box", "msg", "body").count() == 0


def test_long_reply_chain(spark):
    rows = [(1, k, f"text {k}" + (f"\n> text {k - 1}" if k else "")) for k in range(70)]
    got = {r.msg: (r.parent, r.root, r.depth) for r in quotes.link(spark.createDataFrame(rows, "box int, msg int, body string"), "box", "msg", "body").collect()}
    assert got == {k: (k - 1 if k else None, 0, k) for k in range(70)}


def test_conversations_in_reply_order(spark):
    # 1 is answered by 2, 3 and 8; 2 by 4 and 6, 4 by 7, 3 by 5; 9 is another thread; a long chain in another box
    parents = {1: None, 2: 1, 3: 1, 4: 2, 5: 3, 6: 2, 7: 4, 8: 1, 9: None}
    rows = [("m", k, f"text {k}" + (f"\n> text {p}" if p else ""), "ab"[k % 2]) for k, p in parents.items()]
    rows += [("n", k, f"text {k}" + (f"\n> text {k - 1}" if k else ""), "a") for k in range(40)] + [("m", None, "no number\n> text 1", "b"), ("m", 9, "text 99", None)]
    df = spark.createDataFrame(rows, "box string, num int, body string, who string")
    out = quotes.conversations(df, "box", "num", "body", "who").collect()
    assert len(out) == len(rows) - 1
    got = [(r.root, r.num, r.who, r.own) for r in sorted((r for r in out if r.box == "m" and r.num), key=lambda r: (r.root, r.position))]
    assert got == [(9 if k == 9 else 1, k, "ab"[k % 2], f"text {k}") for k in (1, 2, 4, 7, 6, 3, 5, 8, 9)]
    assert sorted(r.position for r in out if r.box == "m" and r.root == 1) == list(range(8))
    assert all(r.position == r.num for r in out if r.box == "n")
    assert [(r.who, r.own, r.position) for r in out if r.num is None] == [("b", "no number", 0)]
    assert quotes.conversations(df.limit(0), "box", "num", "body", "who").count() == 0


def test_conversations_come_back(spark, sf):
    out = queries.Q["op3_quotation_linking"](spark, sf).collect()
    texts = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    assert len(out) == len(texts)
    assert all(r.own_sha256 == hashlib.sha256(texts[r.conv_id, r.turn].strip().encode()).hexdigest() for r in out)
    assert all(r.parent == (r.turn - 1 if r.turn else None) and r.depth == r.turn for r in out if len({texts[r.conv_id, k] for k in range(r.turn + 1)}) == r.turn + 1)


def test_parts_of_messages_link(spark):
    first = "Alpha beta gamma delta one. Second sentence of it is here.\n\nThe middle paragraph stands alone\nwith a second line to it\n\nLast words of the first."
    other = "On Monday Ann wrote:\na letter to me.\n\nUnrelated text of some length"
    rows = [
        (1, 1, first), (1, 2, other),
        (1, 3, "two of three paragraphs\n\nOn 1 May Ann wrote:\n> The middle paragraph stands alone\n> with a second line to it\n>\n> Last words of the first."),
        (1, 4, "half a paragraph, wrapped anew\n> Second sentence\n> of it is here."),
        (1, 5, "a line\n> with a second line to it"),
        (1, 6, "too short\n> words"),
        (1, 7, "of two messages the one that holds more\n> Second sentence of it is here.\n> Unrelated text of some length"),
        (2, 8, "another box\n> with a second line to it"),
    ]
    got = {r.msg: r for r in quotes.link(spark.createDataFrame(rows, "box int, msg int, body string"), "box", "msg", "body").collect()}
    assert {m: (r.n_quotes, r.n_linked, r.parent) for m, r in got.items()} == {
        1: (0, 0, None), 2: (0, 0, None), 3: (1, 1, 1), 4: (1, 1, 1), 5: (1, 1, 1), 6: (1, 0, None), 7: (1, 1, 1), 8: (1, 0, None)}
    # an introduction goes only before the quote that it introduces
    assert got[2].own == other and got[3].own == "two of three paragraphs"


def test_no_python_in_quotation_linking(spark, sf):
    df = queries.Q["op3_quotation_linking"](spark, sf)
    plan = df._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))


def test_normalised_passages(spark):
    got = spark.createDataFrame([("  A\t b\n\nC ",)], "t string").select(quotes.normal(F.col("t"))).first()[0]
    assert got == "a b c"
