"""Queries over pages with cut references, shared urls and equal neighbours, against their SQL."""

import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from changelens.functions import markup
from changelens.operators import pages as P

HTML = (
    "<html><head><title>{head}</title></head><body><nav><a href=\"/x\">x</a></nav><div class=\"ad\">{ad}</div>"
    "<article><h1>{head}</h1><p><b>Some</b> words {body}, and so many more of them that the page is no sparse one by any of the rules of quality that hold here.</article>"
    "<footer>&copy; x</footer></body></html>"
)
HEADS = ["a&amp;&amp", "b &lt", "b &lt", "c&amp;amp &quot", "d &copy; e".replace("&copy; ", ""), "a&amp;b", "g &am"]


@pytest.fixture(scope="module")
def sf(tmp_path_factory):
    at = tmp_path_factory.mktemp("pages")
    db = duckdb.connect()
    db.execute("create table pages (page_id bigint, url varchar, html varchar)")
    rows = [(k, f"https://h.example/{k // 4}", HTML.format(head=HEADS[k // 2 % 7], ad=f"ad {k}", body=f"text {k // 2}")) for k in range(28)]
    db.executemany("insert into pages values (?, ?, ?)", rows)
    db.execute(f"copy pages to '{at}/pages.parquet' (format parquet)")
    return str(at), db


@pytest.mark.parametrize("name", ["q_page_content", "q_page_units", "q_page_block_changes", "q_page_line_changes", "q_gated_changes", "q_discovery_pages", "q_verified_sources", "q_page_blocks"])
def test_odd_pages_equal_their_sql(spark, sf, name):
    at, db = sf
    want = db.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, at).select(*want.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def shown(root):
    return [root.name, root.attrs, [c if isinstance(c, str) else shown(c) for c in root.children]]


def test_plain_pages_have_the_parsers_tree():
    r, plain = random.Random(3), 0
    parts = ["<p>", "</p>", "<br>", "<ul>", "<li>", "</li>", "</ul>", "<h1>", "</h1>", "a &amp b", "x&lt;y ", "&", "&am", "\n", "é&nbsp;", "<td>", "</tr>"]
    odd = ["<a href='/x'>", "<", "a < b", "<title>", "<script>", "<!-- -->", "<P>", "<br/>", "</ p>"]
    for k in range(600):
        html = "".join(r.choice(parts if k % 2 or r.random() < 0.9 else odd) for _ in range(r.randint(0, 14)))
        builder = markup._Builder()
        builder.feed(html)
        builder.close()
        plain += markup._plain(html) is not None
        assert shown(markup.parse(html)) == shown(builder.root), html
    assert plain > 300


def test_rows_become_pages_in_slices(spark):
    class Rows:
        """Stands for a table: keeps the function that would run over its batches."""

        schema = spark.range(0).withColumn("x", F.lit("a")).schema

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802 (the API's name)
            return run

    run = P.per_row(Rows(), ["id"], ["x"], lambda x: (x * 2,), "y string")
    batch = pa.RecordBatch.from_pydict({"id": range(1000), "x": ["a"] * 1000})
    out = list(run(iter([batch, batch.slice(0, 0)])))
    assert max(b.num_rows for b in out) == P.SLICE == 128
    assert pa.Table.from_batches(out).to_pydict() == {"id": list(range(1000)), "y": ["aa"] * 1000}


def test_pages_compared_where_they_are_parsed(spark):
    rows = [(1, "<h1>a</h1><p>b</p>", "<h1>a</h1><p>c</p>"), (2, None, "<table><tr><td>1</td></tr></table>"), (3, "<p>x</p>", "<p>x</p>")]
    df = spark.createDataFrame(rows, "k long, a string, b string")
    side = lambda c: P.parse_pages(df, ["k"], c).select("k", F.transform("blocks", lambda b: b["json"]).alias(c))
    want = P.block_diff(side("a").join(side("b"), "k"), ["k"], "a", "b")
    assert sorted(map(tuple, P.page_diff(df, ["k"], "a", "b").collect())) == sorted(map(tuple, want.collect()))
