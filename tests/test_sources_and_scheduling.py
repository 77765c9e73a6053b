"""Sources, snapshots, quotas and the registered queries."""

import datetime as dt
import io
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from weftline.operators import scheduling
from weftline.sources import stored, text_sources
from weftline.streaming.incremental import stream_tables, upserting


def test_decode_chain(spark):
    values = [b"plain", "é".encode(), b"caf\xe9", b"caf\xe9!", b"\xff\xfea\x00", b"\xef\xbb\xbfx", b"", None, b"\x81\x8d\x8f"]
    rows = spark.createDataFrame([(i, None if v is None else bytearray(v)) for i, v in enumerate(values)], "i int, c binary")
    got = {r.i: r.d for r in rows.select("i", text_sources.decoded(F.col("c")).alias("d")).collect()}
    for i, v in enumerate(values):
        assert (got[i] and tuple(got[i])) == (None if v is None else text_sources.decode(v))
    strict = rows.select("i", text_sources.decoded(F.col("c"), strict_order=False).alias("d")).collect()
    assert strict[3].d.encoding == "cp1252"


def test_html_references_without_semicolon(spark, tmp_path):
    """html_text against its SQL on titles that were cut off within a reference."""
    pages = ["<title>a&amp;&amp</title><p>b&lt", "<h1>&copy &copy; &quot;x&quot</h1>&amplify; & &;", '<script>var t="&amp";if(a&&b){}</script>&amp;lt;', "plain"]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(con.execute(__spark_entry__.oracle_sql()["html_text"]).fetchall())
    assert sorted(map(tuple, __spark_entry__.queries()["html_text"](spark, str(tmp_path)).collect())) == want
    assert text_sources.text_of_closed_html(pages[0]) == "a&&amp\nb&lt" and text_sources.text_of_html(pages[0]) == "a&&\nb<"


def test_html_and_epub(spark, tmp_path):
    assert text_sources.text_of_html("<p>a&amp;b</p><script>x</script><br/>c") == "\na&b\nx\n\nc"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as book:
        book.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        book.writestr("O/p.opf", '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/><item id="a" href="a%201.xhtml" media-type="application/xhtml+xml"/><item id="c" href="c.css" media-type="text/css"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>')
        book.writestr("O/a 1.xhtml", "<p>first</p>")
        book.writestr("O/b.xhtml", "<p>second</p>")
    for name, content in {"one.txt": b"hello", "two.epub": data.getvalue(), "bad.epub": b"no", "x.pdf": b"%PDF", "y.docx": b"?", "blank.txt": b" \n"}.items():
        (tmp_path / name).write_bytes(content)
    got = {r.source_filename: r for r in text_sources.convert(text_sources.read_sources(spark, str(tmp_path))).collect()}
    assert got["one.txt"].text == "hello" and got["one.txt"].error is None
    assert got["two.epub"].text == "\nfirst\n\n\n\nsecond\n"
    assert {n: got[n].error for n in ("bad.epub", "x.pdf", "y.docx", "blank.txt")} == {"bad.epub": "EPUB_CONVERSION_FAILED", "x.pdf": "PDF_CONVERSION_UNAVAILABLE", "y.docx": "UNSUPPORTED_FILE_TYPE", "blank.txt": "SOURCE_EMPTY"}


def test_snapshots_and_json(spark, tmp_path):
    table = stored.Snapshots(spark, str(tmp_path / "t"))
    assert table.read("a int").count() == 0
    table.write(spark.createDataFrame([(1,)], "a int"))
    table.write(table.read("a int").union(spark.createDataFrame([(2,)], "a int")))
    assert sorted(r.a for r in table.read("a int").collect()) == [1, 2] and table.versions() == [1, 2]
    (tmp_path / "k").mkdir()
    (tmp_path / "k/a.json").write_text('{"name":"n","api_key":"s"}')
    (tmp_path / "k/b.json").write_text('{"name":"off","enabled":false}')
    (tmp_path / "k/c.json").write_text('{"name":"empty","api_key":" "}')
    assert [(r.name, r.error) for r in stored.read_credentials(spark, str(tmp_path / "k")).collect()] == [("n", None), ("empty", "PROVIDER_KEY_INVALID")]


def test_stream_upserts_once(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(i, f"v{i}"), (9, f"w{i}")], "id int, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    target = stored.Snapshots(spark, str(tmp_path / "out"))
    for _ in range(2):
        upserting(stream_tables(spark, str(tmp_path / "in"), "id int, v string", 1), lambda df: df, target, "id int, v string", "id", str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.id for r in target.read("id int, v string").collect()) == [0, 1, 2, 9]


def loop(rows, quota):
    """One by one."""
    out, recent, days = {}, {}, {}
    for b, t, n, i in sorted(rows, key=lambda r: (r[0], r[1], r[3])):
        held = [x for x in recent.get(b, []) if x[0] >= t - dt.timedelta(seconds=60)]
        day = (b, t.date())
        ok = len(held) < quota.requests_per_minute and sum(x[1] for x in held) + n <= quota.tokens_per_minute and days.get(day, 0) < quota.requests_per_day
        if ok:
            held.append((t, n))
            days[day] = days.get(day, 0) + 1
        recent[b] = held
        out[i] = ok
    return out


def test_admission_against_a_loop(spark):
    import random

    draw = random.Random(1)
    start = dt.datetime(2024, 1, 1, 23, 50)
    rows = [(draw.choice("ab"), start + dt.timedelta(seconds=draw.randint(0, 1500)), draw.randint(0, 50), i) for i in range(400)]
    quota = scheduling.Quota(5, 120, 60)
    got = scheduling.admitted(spark.createDataFrame(rows, "b string, t timestamp, n int, i long"), "b", "t", "n", "i", quota).collect()
    assert {r.order: r.admitted for r in got} == loop(rows, quota)


@pytest.mark.parametrize("name", [n for n in __spark_entry__.oracle_sql() if not n.startswith("op") and n != "pipeline"])
def test_query_against_duckdb(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    found = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    tidy = lambda rows, names: sorted(([round(r[i], 9) if isinstance(r[i], float) else r[i] for i in sorted(range(len(names)), key=names.__getitem__)] for r in rows), key=repr)
    frame = __spark_entry__.queries()[name](spark, folder)
    assert sorted(frame.columns) == sorted(columns)
    assert tidy(map(tuple, frame.collect()), frame.columns) == tidy(found.fetchall(), columns)
