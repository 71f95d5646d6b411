"""Queries over pages longer than those of the tables, to their ends."""

import hashlib
import random

import duckdb

import __spark_entry__ as entry
from changelens.functions import diffing, markup
from changelens.operators import pages as P


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def test_page_units_are_those_of_the_whole_page(spark, tmp_path):
    paragraphs = [f"paragraph {k}" for k in range(150)]
    items = [f"item {k}" for k in range(100)]
    cards = [f"words {k}" for k in range(70)]
    card = "<div><h3>card</h3>" + "".join(f"<p>{c}</p>" for c in cards) + "</div>"
    html = f"<h1>H</h1>{''.join(f'<p>{p}</p>' for p in paragraphs)}<ul>{''.join(f'<li>{i}</li>' for i in items)}</ul><section>{card}{card}</section><p>end</p>"
    spark.createDataFrame([(1, html)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = entry.queries()["q_page_units"](spark, str(tmp_path)).orderBy("unit_no").collect()
    want = [(t, "H") for t in paragraphs + items] + [("\n".join(cards), "card")] * 2 + [("end", "H")]
    assert [tuple(r) for r in rows] == [(1, k, md5(t), c) for k, (t, c) in enumerate(want)]


def test_flat_pages_have_the_blocks_of_their_tree():
    r, flat = random.Random(5), 0
    texts = ["", " ", "a", "b", "a  b\n", "&amp;", "x &lt;td&gt; y", "&am", "é&nbsp;", "th>", "a > b", "\x1c", "</", "<b>c</b>"]
    text = lambda: r.choice(texts[:-2] if r.random() < 0.99 else texts)
    cell = lambda: "<{0}>{1}</{0}>".format(r.choice(["td", "td", "th"]), text())
    for k in range(4000):
        halves = 2 if k % 5 == 0 else 1  # children that repeat
        row = lambda: "<tr>" + "".join(cell() for _ in range(r.randint(0, 4))) * halves + "</tr>"  # noqa: B023, E731
        table = lambda: "<table>" + "".join(row() for _ in range(r.randint(0, 5))) * r.choice([1, halves]) + "</table>"  # noqa: B023, E731
        head = lambda: "<h{0}>{1}</h{0}>".format(r.randint(1, 6), text())
        html = "".join(r.choice([head, table])() for _ in range(r.randint(0, 4))) * r.choice([1, halves])
        html += r.choice(["", "", "", "", "", "\n", "<p>p</p>", "<h1>a</h2>", "<table>"])
        made = markup._flat(html)
        flat += bool(made)
        assert made is None or made == markup._body(markup.parse(html), html), html
        assert markup.blocks_of(html) == markup.extract(html)[2], html
    assert flat > 1000


def test_row_changes_are_those_of_all_changes(spark):
    r = random.Random(6)
    table = lambda: "<table><tr><th>k</th><th>v</th></tr>" + "".join(f"<tr><td>{r.choice('abc')}</td><td>{r.randint(0, 2)}</td></tr>" for _ in range(r.randint(0, 3))) + "</table>"
    parts = [table, table, lambda: f"<h{r.randint(1, 2)}>{r.choice('xy')}</h1>", lambda: f"<p>{r.choice('pq')}</p>", lambda: "<ul><li>i</li></ul>"]
    page = lambda: "".join(r.choice(parts)() for _ in range(r.randint(0, 4)))
    pairs = [(k, page(), page()) for k in range(600)] + [(600, None, page()), (601, None, None)]
    want = []
    for k, a, b in pairs:
        changes = diffing.contextual(*[markup.blocks_of(x or "") for x in (a, b)])
        want += [(k, x["change"], x["row_key"], [(c["column"], c["previous"], c["current"]) for c in x["changed_cells"]]) for c in changes for x in c.get("rows", ())]
    got = P.row_changes(spark.createDataFrame(pairs, "k long, a string, b string").coalesce(1), ["k"], "a", "b").collect()
    assert [(x.k, x.change, x.row_key, [tuple(c) for c in x.changed_cells]) for x in got] == want
    assert len(want) > 200


def test_order_table_changes_shuffle_once_and_equal_their_sql(spark, tmp_path):
    r, db = random.Random(7), duckdb.connect()
    db.execute("create table lineitem (l_orderkey bigint, l_linenumber integer, l_quantity double)")
    rows = [(r.randint(0, 80), r.randint(1, 12), float(r.randint(1, 50))) for _ in range(600)] + [(100, 1, 2.0), (103, 2, 2.0), (102, 2, 2.0), (None, 1, 2.0), (None, 2, 2.0)]
    db.executemany("insert into lineitem values (?, ?, ?)", rows)
    db.execute(f"copy lineitem to '{tmp_path}/lineitem.parquet' (format parquet)")
    want = db.sql(entry.oracle_sql()["q_order_table_changes"])
    made = entry.queries()["q_order_table_changes"](spark, str(tmp_path))
    assert sorted(map(repr, map(tuple, made.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))
    plan = made._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
