import pytest
from pyspark.sql import functions as F

from changelens.functions import chunking, diffing, markup
from changelens.functions import text as T
from changelens.functions import urls as U
from changelens.functions.identity import all_keys, fingerprint, state_key


def value(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


def test_collapse_and_newlines(spark):
    assert value(spark, T.collapse(F.col("a")), a=" x\u00a0\u3000y\n z ") == "x y z"
    assert value(spark, T.normalize_newlines(F.col("a")), a="\r\n a\r\nb\rc \n") == "a\nb\nc"


@pytest.mark.parametrize(
    ("text", "first", "every"),
    [
        ("2024-02-30 or 2024年1月9日", "2024-01-09", ["2024-01-09"]),
        ("March 5th, 2024; 7 April 2023", "2024-03-05", ["2024-03-05"]),
        ("v2024.01.02", "2024-01-02", []),
        ("0000-01-01 and 1999-01-02", None, ["1999-01-02"]),
        ("February 30, 2024", None, []),
        ("12024-01-019", None, []),
    ],
)
def test_dates(spark, text, first, every):
    got = value(spark, T.first_date(F.col("a")), a=text)
    assert (got.isoformat() if got else None) == first
    assert value(spark, T.dates_in(F.col("a")), a=text) == every


def test_secrets_and_redaction(spark):
    assert value(spark, T.contains_secret(F.col("a")), a="API_KEY = abc")
    assert not value(spark, T.contains_secret(F.col("a")), a="a token of thanks")
    assert value(spark, T.redact(F.col("a")), a="see C:\\Users\\x") == "[path]"


def test_instants(spark):
    assert value(spark, T.parse_instant(F.col("a")), a="2024-01-01T00:00:00") is None
    assert value(spark, T.parse_instant(F.col("a")), a="2024-01-01T00:00:00+00:00") is not None
    assert value(spark, T.case_instant(F.col("a")), a="undated; retrieved 2024-01-02") is not None


def test_list_identity_is_json(spark):
    import hashlib
    import json

    want = hashlib.sha256(json.dumps(["a\"b", "é", None], ensure_ascii=False).encode()).hexdigest()
    assert value(spark, T.list_identity(F.col("a"), F.col("b"), F.lit(None).cast("string")), a='a"b', b="é") == want


def test_urls(spark):
    assert value(spark, U.url_key(F.col("a")), a="HTTP://Ex.com?q=1#f") == "http://ex.com/?q=1"
    assert value(spark, U.registrable_domain(F.col("a")), a="a.b.co.uk") == "b.co.uk"
    assert value(spark, U.match_kind(F.col("a"), F.col("b")), a="http://x.com/a/", b="http://X.com/a") == "equivalent"
    for url, ok in (("https://x.com", True), ("ftp://x.com", False), ("http://", False), ("http://x.com:99999", False), ("http://x.com:8o", False)):
        assert value(spark, U.is_valid(F.col("a")), a=url) is ok, url
    for url, ok in (("http://10.0.0.1/", False), ("http://8.8.8.8/", True), ("http://localhost/", False), ("http://u@x.com/", False), ("http://x.com:8080/", False), ("https://x.com/", True)):
        assert value(spark, U.is_public(F.col("a")), a=url) is ok, url


def test_link_noise(spark):
    noise = lambda url, text: value(spark, U.is_noise(F.col("u"), F.col("t"), F.lit(False)), u=url, t=text)
    assert noise("https://x.com/docs", "") and noise("https://www.facebook.com/p", "page") and noise("https://a.b/x.zip", "get")
    assert noise("https://a.b/sign-in/", "go") and noise("https://a.b/p", "Privacy Policy") and not noise("https://a.b/docs/api", "API docs")


def test_state_key_folds(spark):
    df = spark.createDataFrame([(["Plan"], ["Ｐro  "]), (["PLAN"], ["pro"]), (None, ["x"])], "a array<string>, b array<string>")
    got = [r.k for r in df.select(state_key("a", "b").alias("k")).collect()]
    assert got[0] == got[1] and got[0].startswith("interactive-state:") and got[2] is None


def test_json_identity(spark):
    df = spark.createDataFrame([('{"b": {"Gold": 1}, "a": [2, {"c": 3}]}',), ('{"a": [2, {"c": 3}], "b": {"Gold": 1}}',)], "j string")
    rows = df.select(fingerprint("j").alias("f"), all_keys("j").alias("k")).collect()
    assert rows[0].f == rows[1].f and rows[0].k == ["a", "b", "c", "gold"]


def test_words_split_by_span_and_noise():
    title, content, blocks = markup.extract("<title> A  B </title><nav>no</nav><h2>H</h2><p>Av<span>ail</span>able<br>now</p><pre>a\n  b</pre><script>x</script>")
    assert title == "A B" and content == "## H\n\nAvailable now\n\n```\na\n  b\n```"
    assert [b["type"] for b in blocks] == ["heading", "paragraph", "code"]


def test_lists_nest_and_unclosed_paragraph_swallows():
    _, content, _ = markup.extract("<ol><li>one<ul><li>in</li></ul></li><li></li><li>two</li></ol><p>a<p>b")
    assert content == "1. one\n  - in\n2. two\n\na b"


def test_tables_and_cells():
    _, content, blocks = markup.extract("<table><tr><th>n</th><th>v</th></tr><tr><td>a|b</td><td>1<table><tr><td>x</td></tr></table></td></tr></table>")
    assert content == "| n | v |\n| --- | --- |\n| a\\|b | 1 |" and blocks[0]["rows"] == [["a|b", "1"]]


def test_repeated_halves():
    half = "<li>a</li><li>b</li><li>c</li>"
    assert len(markup.extract(f"<ul>{half}{half}</ul>")[2][0]["items"]) == 3
    assert len(markup.extract(f"<ul>{half}{half}<li>d</li></ul>")[2][0]["items"]) == 7
    assert len(markup.extract("<ul>" + "<li>a</li>" * 6 + "</ul>")[2][0]["items"]) == 6


def test_cards():
    card = "<div><h3>{}</h3><p>{}</p></div>"
    _, content, blocks = markup.extract("<section>" + card.format("A", "one <del>5</del>") + card.format("B", "two") + "</section>")
    assert blocks[0]["type"] == "group" and [c["title"] for c in blocks[0]["cards"]] == ["A", "B"]
    assert blocks[0]["cards"][0]["text_marks"] == [{"text": "5", "marks": ["strikethrough"]}] and content == "### A\n\none 5\n\n### B\n\ntwo"


def test_signals_in_fixed_order():
    assert markup.signals('<b aria-selected="true" role="tab">') == ["role_tab", "aria_selected"]


def test_chunks():
    got = chunking.chunks("# A\n\none\n\ntwo\n\n## B\n\n|a|b|\n|-|-|\n|1|2|\n\n```\n# x\n\ny\n```")
    assert [c["heading_path"] for c in got] == [["A"], ["A", "B"], ["A", "B"]]
    assert got[0]["content"] == "one\n\ntwo" and got[1]["table_context"] == "|a|b|\n|-|-|" and "# x" in got[2]["content"]
    text = "word. " * 700
    parts = chunking.chunks(text, limit=200)
    assert all(len(c["content"]) <= 200 for c in parts) and "".join(c["content"] for c in parts) == text.strip()
    with pytest.raises(chunking.ChunkError):
        chunking.chunks("# only")


def test_contextual_diff():
    blocks = lambda h: markup.extract(h)[2]
    table = "<h1>T</h1><table><tr><th>n</th><th>v</th></tr><tr><td>a</td><td>{}</td></tr></table>"
    got = diffing.contextual(blocks(table.format(1)), blocks(table.format(2)))
    assert got[0]["rows"] == [{"change": "modified", "row_key": "a", "changed_cells": [{"column": "v", "previous": "1", "current": "2"}]}]
    assert diffing.contextual(None, []) is None
    assert diffing.contextual(blocks("<h1>a</h1>"), blocks("<h1>b</h1>")) == []
    moved = diffing.contextual(blocks("<ul><li>p<ul><li>x</li></ul></li><li>q</li></ul>"), blocks("<ul><li>p</li><li>q<ul><li>x</li></ul></li></ul>"))
    assert {(i["change"], tuple(i["parents"])) for i in moved[0]["items"]} == {("deleted", ("p",)), ("added", ("q",))}


def test_statement_units():
    blocks = markup.extract("<h2>H</h2><p>a</p><ul><li>b<ul><li>d</li></ul></li><li>c</li></ul><table><tr><th>x</th></tr><tr><td>1</td></tr></table>")[2]
    assert chunking.statement_units(blocks) == [("a", "H"), ("b", "H"), ("c", "H"), ("d", "H"), ("1", "x")]


def test_pages_may_be_nested_as_deep_as_they_are_long():
    for tag in ("div", "blockquote", "b", "ul><li", "dl><dd", "table><tr><td", "a href=x", "p><a href=x", "section><h2>t</h2"):
        title, content, blocks = markup.extract("<title>T</title>" + f"<{tag}>" * (2000 if "h2" in tag else 20_000) + "deep")
        assert title == "T" and markup.canonical(blocks) and ("deep" in content or "table" in tag)  # a table within a cell is none of its text
    nested = markup.extract("<ul><li>x" * 200)[2][0]
    depth, n = 0, 0
    while nested:
        depth, n = depth + 1, n + len(nested["items"])
        nested = next((i["children"][0] for i in nested["items"] if i["children"]), None)
    assert (depth, n) == (markup.MAX_NEST, 200)  # deeper items go on at the last level
    assert len(markup.page_links("<a href=x>" * 20_000)) == 20_000


def test_equal_subtrees_have_equal_digests():
    root = markup.parse("<div><p class=x id=y>a <b>b</b></p><p id=y class=x> a  <b>b</b> </p><p class=x id=y>a b</p><p class=x>a <b>b</b></p></div>")
    prints = markup.fingerprints(root)
    a, b, c, d = (prints[id(x)] for x in root.elements()[0].elements())
    assert a == b and len({a, c, d}) == 3


# The examples of RFC 3986, 5.4, against http://a/b/c/d;p?q.
RFC = """g:h g:h|g http://a/b/c/g|./g http://a/b/c/g|g/ http://a/b/c/g/|/g http://a/g|//g http://g|?y http://a/b/c/d;p?y|g?y http://a/b/c/g?y|#s http://a/b/c/d;p?q#s|g#s http://a/b/c/g#s
g?y#s http://a/b/c/g?y#s|;x http://a/b/c/;x|g;x http://a/b/c/g;x|g;x?y#s http://a/b/c/g;x?y#s| http://a/b/c/d;p?q|. http://a/b/c/|./ http://a/b/c/|.. http://a/b/|../ http://a/b/|../g http://a/b/g
../.. http://a/|../../ http://a/|../../g http://a/g|../../../g http://a/g|../../../../g http://a/g|/./g http://a/g|/../g http://a/g|g. http://a/b/c/g.|.g http://a/b/c/.g|g.. http://a/b/c/g..|..g http://a/b/c/..g
./../g http://a/b/g|./g/. http://a/b/c/g/|g/./h http://a/b/c/g/h|g/../h http://a/b/c/h|g;x=1/./y http://a/b/c/g;x=1/y|g;x=1/../y http://a/b/c/y|g?y/./x http://a/b/c/g?y/./x|g?y/../x http://a/b/c/g?y/../x|g#s/../x http://a/b/c/g#s/../x"""


def test_references_resolve_as_the_rfc_says(spark):
    cases = [tuple(x.split(" ")) for x in RFC.replace("\n", "|").split("|")]
    df = spark.createDataFrame(cases, "ref string, want string")
    assert [(r.ref, r.got) for r in df.select("ref", "want", U.resolve(F.lit("http://a/b/c/d;p?q"), F.col("ref")).alias("got")).collect() if r.got != r.want] == []
    more = spark.createDataFrame([("http://h", "x"), ("http://h/a//b", "../c"), (None, "x"), ("http://h", None)], "base string, ref string")
    assert [r[0] for r in more.select(U.resolve(F.col("base"), F.col("ref"))).collect()] == ["http://h/x", "http://h/a/c", None, None]
    links = spark.createDataFrame([("/x#y",), ("mailto:a@b.c",), ("//u:p@h/x",), ("  ",), ("ftp://h/x",), (None,), (" z? ",), ("HTTP://H/x",), ("http:///x",)], "href string")
    assert [r[0] for r in links.select(U.candidate(F.lit("https://h/a/b"), F.col("href"))).collect()] == ["https://h/x", None, "https://u:p@h/x", None, None, None, "https://h/a/z", "http://H/x", None]
