import html
import random
import re
import time
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docsieve.functions import text as tx
from docsieve.operators import text as op
from docsieve.sources import docs as src
from docsieve.sources import tables as tb


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("page, want", [
    ("<p>Hello <b>World</b></p>", "Hello \nWorld"),
    ("<script>var t='</p>'</script><nav>menu</nav><p>Body</p><footer>f</footer><header>h</header>", "Body"),
    ("<p>a</p>\n\n\n\n\n<p>b</p>", "a\n\nb"),
    ("<p>a    b</p>", "a b"),
    ("", ""),
    (None, ""),
    ("<head><title>T</title></head><p>x</p>", "T\nx"),
    ("a<!-- c -->b", "a\nb"),
    ("<!DOCTYPE html><p>x &lt;y&gt; &amp;amp; &#233;&#x1F600; &nosuch; &copy;</p>", "x <y> &amp; é😀 &nosuch; ©"),
    ("<script>never closed <p>x", ""),
    ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
])
def test_clean_html(spark, page, want):
    assert one(spark, tx.clean_html, page) == want


class _Text(HTMLParser):
    """Visible text pieces of a page, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip, self.parts, self.fresh = 0, [], True

    def handle_starttag(self, tag, attrs):
        self.skip += tag in tx.DROPPED_ELEMENTS
        self.fresh = True

    def handle_endtag(self, tag):
        self.skip -= tag in tx.DROPPED_ELEMENTS
        self.fresh = True

    def handle_comment(self, data):
        self.fresh = True

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data) if self.fresh else self.parts.__setitem__(-1, self.parts[-1] + data)
            self.fresh = False


def test_clean_html_equals_parser_on_pages(spark, sf):
    import re

    rows = spark.read.parquet(f"{sf}/pages.parquet").select("html", tx.clean_html(F.col("html")).alias("got")).collect()
    for r in rows:
        p = _Text()
        p.feed(r.html)
        p.close()
        text = re.sub(" {2,}", " ", re.sub("\n{3,}", "\n\n", "\n".join(p.parts))).strip()
        assert r.got == text


def test_strip_and_entities(spark):
    assert one(spark, tx.strip, "  \t\x1c x y \n ") == "x y"
    for raw in ("&quot;&apos;&nbsp;&euro;", "&#0;", "&#xD800;", "&&amp;&", "&amp"):
        want = html.unescape(raw) if raw != "&amp" else "&amp"
        assert one(spark, tx.decode_entities, raw) == want


@pytest.mark.parametrize("text, size, overlap, want", [
    ("short", 100, 10, ["short"]),
    ("", 10, 2, []),
    (None, 10, 2, []),
    ("A" * 100, 30, 10, ["A" * 30] * 4 + ["A" * 20]),
    ("  x  ", 10, 2, ["  x  "]),
])
def test_fixed(spark, text, size, overlap, want):
    assert one(spark, lambda c: tx.fixed_chunks(c, size, overlap), text) == want


@settings(max_examples=25, deadline=None)
@given(st.text(alphabet="ab é😀", max_size=60), st.integers(2, 20), st.data())
def test_fixed_covers_the_text(spark, text, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    got = one(spark, lambda c: tx.fixed_chunks(c, size, overlap), text)
    if len(text) <= size:
        assert got == ([text] if text else [])
        return
    step = size - overlap
    assert all(g == text[i * step:i * step + size] for i, g in enumerate(got))
    assert "".join(g[:step] for g in got) == text


def test_bad_overlap():
    for f in tx.fixed_chunks, tx.sentence_chunks, tx.semantic_chunks:
        with pytest.raises(ValueError):
            f(None, 10, 10)


@pytest.mark.parametrize("text, size, overlap, want", [
    ("One two three. Four five six! Seven eight? Nine ten.", 32, 0, ["One two three. Four five six!", "Seven eight? Nine ten."]),
    ("One two three. Four five six! Seven eight? Nine ten.", 32, 4,
     ["One two three. Four five six!", "six! Seven eight? Nine ten."]),
    ("A very long sentence without any end in it. Short.", 20, 0, ["A very long sentence without any end in it.", "Short."]),
    ("Uno. Dos. Tres cuatro cinco.", 10, 0, ["Uno. Dos.", "Tres cuatro cinco."]),
    ("", 10, 0, []),
])
def test_sentence(spark, text, size, overlap, want):
    assert one(spark, lambda c: tx.sentence_chunks(c, size, overlap), text) == want


@pytest.mark.parametrize("text, size, overlap, want", [
    ("aaa\n\nbbb\n\nccc", 9, 0, ["aaa\n\nbbb", "ccc"]),
    ("aaa\n\nbbb\n\nccc", 9, 2, ["aaa\n\nbbb", "bb\n\nccc"]),
    ("aaa\n\nLong one here. And another.\n\nbbb", 15, 3, ["aaa", "Long one here.", "re. And another.", "bbb"]),
    ("\n\n  \n\nab\n\n\n\n  cd  \n\n", 6, 0, ["ab\n\ncd"]),
    ("", 10, 0, []),
])
def test_semantic(spark, text, size, overlap, want):
    assert one(spark, lambda c: tx.semantic_chunks(c, size, overlap), text) == want


def test_strategy_and_chunk_table(spark):
    df = spark.createDataFrame([("u", "<p>" + "x" * 120 + "</p>"), ("v", ""), ("w", None)], "url string, text string")
    with pytest.raises(ValueError):
        op.chunk(df, "text", "paragraph")
    rows = op.build_chunks(df, strategy="fixed", size=100, overlap=10, min_size=20).orderBy("chunk_index").collect()
    assert [(r.chunk_id, len(r.chunk_text)) for r in rows] == [("u_0", 100), ("u_1", 30)]
    # A short chunk is dropped, the index of the others stays.
    assert [r.chunk_id for r in op.build_chunks(df, strategy="fixed", size=100, overlap=10, min_size=50).collect()] == ["u_0"]


def test_sync_changes(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "chunk_id string, t string")
    new = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", None), ("d", "4")], "chunk_id string, t string")
    got = {r.chunk_id: r.change for r in op.sync_changes(old, new).collect()}
    assert got == {"b": "update", "d": "insert"}
    assert {r.change for r in op.sync_changes(new, old).collect()} == {"update", "delete"}


def test_read_docs_and_sitemap(spark, tmp_path):
    f = tmp_path / "d.json"
    f.write_text('[{"url": "a", "text": "x"}, {"url": "b", "text": null}, {"url": "c", "text": "y"}]')
    assert src.read_docs(spark, str(f)).count() == 2
    assert src.read_docs(spark, str(f), max_docs=1).count() == 1
    f.write_text('[{"url": "b", "text": null}]')
    with pytest.raises(ValueError):
        src.read_docs(spark, str(f))
    xml = spark.createDataFrame([("<urlset><url><loc>u1</loc></url>\n<url><loc> u2 </loc></url></urlset>",)], "value string")
    assert [(r.position, r.url) for r in src.sitemap_urls(xml).collect()] == [(0, "u1"), (1, "u2")]
    assert src.sitemap_urls(xml, max_docs=1).count() == 1


def test_article(spark):
    pages = spark.createDataFrame([
        ("a", "<script>'<article>no</article>'</script><article class='x'>in <b>it</b></article>"), ("b", "<div>none</div>"),
        ("c", '<div class="theme main">one</div>'),
    ], "url string, html string")
    assert [r.text for r in src.extract_article(pages).collect()] == ["<article class='x'>in <b>it</b></article>"]
    assert [r.url for r in src.extract_article(pages, "div", "theme main").collect()] == ["c"]


def test_nested_and_unclosed_elements(spark):
    inner = "<div class='x'><p>a</p><div>b<DIV>c</DIV></div><p>kept</p></div>"
    deep = "<article>" * 2000 + "x" + "</article>" * 2000
    rows = [
        ("nested", f"<html>{inner}<div>after</div>"), ("open", "<div class='x'>a<div>b</div> to the end"),
        ("deep", deep), ("other", "<divider class='x'>a</divider>"), ("null", None), ("empty", ""),
    ]
    pages = spark.createDataFrame(rows, "url string, html string")
    assert {r.url: r.text for r in src.extract_article(pages, "div", "x").collect()} == {"nested": inner, "open": "<div class='x'>a<div>b</div> to the end"}
    assert {r.url: r.text for r in src.extract_article(pages).collect()} == {"deep": deep}


def test_markdown_corpus(spark, tmp_path):
    (tmp_path / "my-skill").mkdir()
    (tmp_path / "my-skill" / "SKILL.md").write_text('---\nname: "One"\ndescription: does one\n---\nbody')
    (tmp_path / "plain.md").write_text("no head")
    got = {r.name: (r.description, r.folder) for r in src.read_markdown_corpus(spark, str(tmp_path)).collect()}
    assert got == {"One": ("does one", "my-skill"), "plain": ("", "plain")}
    index = src.corpus_index(src.read_markdown_corpus(spark, str(tmp_path)))
    assert src.index_text(index).first().index_text == "1. **One**: does one\n2. **plain**: "


def test_tables(spark, tmp_path):
    a = spark.createDataFrame([(1, "x")], "id int, t string")
    tb.save_append(a, str(tmp_path / "t"))
    tb.save_append(spark.createDataFrame([(2, 0.5)], "id int, s double"), str(tmp_path / "t"))
    assert sorted((r.id, r.t, r.s) for r in tb.read_merged(spark, str(tmp_path / "t")).collect()) == [(1, "x", None), (2, None, 0.5)]
    assert src.corpus_stats(spark.createDataFrame([("x" * 5000,), ("y",)], "text string")).first().truncated == 1


def test_team_settings(spark):
    cfg = spark.createDataFrame(
        [("hr", "hr_bot", "", "", ""), ("pe", "pe_bot", "s", "a", "c")],
        "team string, agent_name string, schema string, audit_schema string, chatbot_name string")
    got = {r.team: r[2:] for r in tb.team_settings(cfg).collect()}
    assert got == {"hr": ("hr_bot", "hr_bot_audit", "hr-bot-chatbot"), "pe": ("s", "a", "c")}
    shared = spark.createDataFrame([("g", "shared.json"), ("h", "shared2.json")], "k string, path string")
    team = spark.createDataFrame([("g", "team.json"), ("h", "")], "k string, path string")
    assert {r.k: r.path for r in tb.resolve_dataset(team, shared, "k", ["path"]).collect()} == {"g": "team.json", "h": "shared2.json"}


def test_long_runs_and_quoted_values(spark):
    from docsieve.functions.text import clean_html, strip

    pages = ["a" + "<td></td>" * 50_000 + "b", '<a title="1 > 0" href="#">link</a>', "x" + " " * 500_000 + "y \n"]
    df = spark.createDataFrame([(p,) for p in pages], "html string")
    assert [r[0] for r in df.select(clean_html(df["html"])).collect()] == ["a\nb", "link", "x y"]
    assert df.select(strip(df["html"])).collect()[2][0] == pages[2].strip()


def old_clean(page):
    """The patterns one after the other, without setting anything aside."""
    body = re.sub(rf"(?is)<!--.*?-->|{tx._RAW}".replace(r"\z", r"\Z"), "<br>", page)
    body = re.sub(rf"(?is){tx._BLOCK}", "<br>", body)
    return re.sub(rf"(?s){tx._TAG_RUN}", "\n", body)


def test_cleaning_equals_plain_patterns(spark):
    rng = random.Random(4)
    bits = ["<!--", "-->", "<script>", "</script>", "<SCRIPT a", "<style ", "</style >", "<nav>", "<nav ", "</nav>", "</NAV  >", "<header>", "</header>", "<footer x='>'", "</footer>",
            ">", "<", "x", " ", "\n", "<b>", "</b>", "'", '"', "->", "<!-->", "<p a=\"1>2\">", "é"]
    pages = ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(4000)]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string").repartition(4)
    got = {r.i: r.t for r in df.select("i", tx._drop_tags(tx._drop_blocks(tx.drop_raw(F.col("html"), "<br>"), "<br>"), "\n").alias("t")).collect()}
    for i, page in enumerate(pages):
        assert got[i] == old_clean(page), repr(page)


@pytest.mark.parametrize("piece", ["<!--", "<nav>", "<nav ", "<script ", "<style", "<header>x", "<!-- -- ", "<a ", "</nav", "<footer <b"])
@pytest.mark.parametrize("end", ["", "</nav>", "-->", ">"])
def test_cleaning_is_linear(spark, piece, end):
    df = spark.createDataFrame([(piece * (1_000_000 // len(piece)) + end,)], "html string")
    start = time.time()
    df.select(F.length(tx.clean_html(F.col("html")))).collect()
    assert time.time() - start < 8
