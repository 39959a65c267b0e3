"""Readers and sinks."""

import io
import struct
import tarfile

import pytest
from pyspark.sql import functions as F

from skyloom.sources import artifacts as A
from skyloom.sources import binary as B
from skyloom.sources import text as T
from skyloom.streaming.history import history_stream


def test_delimited(spark, tmp_path, rows):
    (tmp_path / "a.csv").write_text('id,name\n1,"x,\ny"\n2,\n')
    (tmp_path / "b.csv").write_text("id,name\n3,z\n")
    (tmp_path / "c.csv").write_text("name,id\n3,z\n")
    (tmp_path / "d.csv").write_text("4,more\n")
    paths = [str(tmp_path / f"{x}.csv") for x in "ab"]
    assert rows(T.read_all_text(spark, paths)) == [("1", "x,\ny"), ("2", None), ("3", "z")]
    with pytest.raises(ValueError):
        T.read_all_text(spark, [paths[0], str(tmp_path / "c.csv")])
    assert rows(T.read_continued(spark, paths[1], [str(tmp_path / "d.csv")])) == [("3", "z", "b.csv"), ("4", "more", "d.csv")]
    with pytest.raises(Exception, match="unaccounted"):
        T.with_member(spark.read.text(paths[0]), {"b.csv": "second"}).collect()


def test_lines_tokens_blocks(spark, tmp_path):
    (tmp_path / "x.txt").write_text("@ one\n1 2  3 4\n\n@ two\n5 6")
    lines = T.read_lines(spark, str(tmp_path / "x.txt"))
    assert [r["text"] for r in lines.orderBy("source_line_number").collect()] == ["@ one", "1 2  3 4", "", "@ two", "5 6"]
    blocks = T.read_blocks(lines, "^@").where(~F.col("text").startswith("@") & (F.col("text") != ""))
    got = T.read_tokens(blocks, ["a", "b", "c"]).orderBy("source_line_number").collect()
    assert [(r["block"], r["a"], r["b"], r["c"]) for r in got] == [(1, "1", "2", "3 4"), (2, "5", "6", None)]


def test_byte_layout(spark, rows):
    layout = T.parse_byte_layout("   Bytes Format Units Label Explanations\n   1-  6  I6    ---   seq   Number\n   8- 10  A3    ---   name  Name\n     12  F1.0  mag   m     Magnitude\n")
    df = spark.createDataFrame([("     7 abc 5",), ("     x     ",)], "line string")
    assert rows(T.fixed_width(df, "line", layout)) == [(7, "abc", 5.0), (None, "", None)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(3, "b"), (1, "a"), (2, "b")], "k int, quantity_key string")
    T.write_ordered(df, str(tmp_path / "o"), ["k"], 1)
    assert [r["k"] for r in spark.read.parquet(str(tmp_path / "o")).collect()] == [1, 2, 3]
    T.write_per_quantity(df, str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q")).where("quantity_key = 'b'").count() == 2
    with pytest.raises(ValueError):
        T.write_per_quantity(spark.createDataFrame([(1, "Bad Name")], "k int, quantity_key string"), str(tmp_path / "z"))


HTML = b"<table id=t><tr><th>Name<th>Ref</tr><tr><td>A &amp; B</td><td><a href='u'>see</a></td></tr></table><table><tr><td>x<table><tr><td>in</td></tr></table></td></tr></table>"


def test_html(spark, rows):
    df = spark.createDataFrame([("p", HTML), ("q", None), ("r", b"no table")], "page string, html binary")
    got = rows(B.parse_cells(df, "html", "html", "page"), "page", "part", "row_number", "column_number", "text", "link")
    assert ("p", "t", 1, 0, "A & B", None) in got and ("p", "t", 1, 1, "see", "u") in got and ("p", "2", 0, 0, "in", None) in got and {g[0] for g in got} == {"p"}


def test_votable(spark):
    xml = b'<VOTABLE><RESOURCE><TABLE name="t"><FIELD name="a"/><FIELD name="b"/><DATA><TABLEDATA><TR><TD>1</TD><TD></TD></TR><TR><TD>2</TD><TD>x</TD></TR></TABLEDATA></DATA></TABLE></RESOURCE></VOTABLE>'
    cells = B.parse_cells(spark.createDataFrame([("f", xml)], "f string, c binary"), "votable", "c", "f")
    assert sorted((r["a"], r["b"]) for r in B.cells_to_table(cells, ["a", "b"]).collect() if r["b"]) == [("2", "x")]


def card(key, value):
    return f"{key:8}= {value}".ljust(80).encode()


def fits_file():
    pad = lambda b, c: b + c * (-len(b) % 2880)
    head = pad(card("SIMPLE", "T") + card("BITPIX", "8") + card("NAXIS", "0") + b"END".ljust(80), b" ")
    table = card("XTENSION", "'BINTABLE'") + card("BITPIX", "8") + card("NAXIS", "2") + card("NAXIS1", "16") + card("NAXIS2", "2") + card("PCOUNT", "0") + card("TFIELDS", "3")
    table += card("TTYPE1", "'k'") + card("TFORM1", "'J'") + card("TNULL1", "-1") + card("TTYPE2", "'v'") + card("TFORM2", "'2E'") + card("TTYPE3", "'s'") + card("TFORM3", "'4A'") + b"END".ljust(80)
    data = struct.pack(">i2f4s", 7, 1.5, float("nan"), b"ab  ") + struct.pack(">i2f4s", -1, 2.0, 3.0, b"    ")
    return head + pad(table, b" ") + pad(data, b"\0")


def test_fits_and_tar(spark, tmp_path):
    (tmp_path / "x.fits").write_bytes(fits_file())
    got = {(r["row_number"], r["column_name"]): r["text"] for r in B.read_files(spark, str(tmp_path / "x.fits"), "fits").collect()}
    assert got == {(0, "k"): "7", (0, "v"): "[1.5 --]", (0, "s"): "ab", (1, "k"): None, (1, "v"): "[2.0 3.0]", (1, "s"): None}
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w") as tar:
        info = tarfile.TarInfo("d/a.txt")
        info.size = 3
        tar.addfile(info, io.BytesIO(b"abc"))
    (tmp_path / "x.tar").write_bytes(buffer.getvalue())
    row = B.read_files(spark, str(tmp_path / "x.tar"), "tar").first()
    assert (row["member"], row["size"], bytes(row["content"])) == ("d/a.txt", 3, b"abc")


def test_history_stream(spark, tmp_path, rows):
    for i, data in enumerate(["k,2021-01-02,a\n", "k,2021-01-05,b\nm,2021-01-01,c\n", "k,2021-01-01,z\n"]):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.csv").write_text(data)
        stream = spark.readStream.schema("k string, t date, p string").csv(str(tmp_path / "in")).select("k", F.col("t").alias("f"), F.col("t").alias("l"), "p")
        history_stream(stream, str(tmp_path / "out"), str(tmp_path / "check"), ["k"], "f", "l", ["p"]).awaitTermination()
    got = [(k, str(f), str(l), p) for k, f, l, p in rows(spark.read.parquet(str(tmp_path / "out" / "v2")))]
    assert got == [("k", "2021-01-01", "2021-01-05", "b"), ("m", "2021-01-01", "2021-01-01", "c")]


def test_artifacts(spark, tmp_path):
    df = spark.createDataFrame([(i, f"n{i}", None if i % 3 else 1.5) for i in range(50)], "k int, n string, d double")
    manifest = A.write_artifact(df, str(tmp_path / "a"), ["k"])
    assert manifest["n_rows"] == 50 and A.read_artifact(spark, str(tmp_path / "a")).count() == 50
    df.where("k <> 3").write.mode("overwrite").parquet(str(tmp_path / "a" / "data"))
    with pytest.raises(ValueError, match="manifest"):
        A.read_artifact(spark, str(tmp_path / "a"))
    A.write_serving(df, str(tmp_path / "s"), ["d"], "k")
    assert spark.read.parquet(str(tmp_path / "s")).count() == 50


def test_json_table_and_tiles(spark, tmp_path, rows):
    (tmp_path / "t.json").write_text('{"fields": [{"name": "a", "type": "int"}, {"name": "b", "type": "char"}], "data": [[1, "x"], [null, "y"]]}')
    assert rows(A.read_json_table(spark, str(tmp_path / "t.json"))) == [(1, "x"), (None, "y")]
    p = spark.createDataFrame([("t", 2, 1.0, 2.0, 3.0), ("t", 1, 0.5, 0.0, 0.0), ("u", 3, 0.0, 0.0, 0.0)], "tile string, id long, x double, y double, z double")
    got = {r["tile"]: (r["n"], bytes(r["payload"])) for r in A.tile_payloads(p, "tile", "id").collect()}
    assert got["t"] == (2, struct.pack("<qfff", 1, 0.5, 0, 0) + struct.pack("<qfff", 2, 1, 2, 3)) and got["u"][0] == 1


def test_lenient_compressed_and_empty(spark, tmp_path, rows):
    import gzip

    with gzip.open(tmp_path / "a.csv.gz", "wt") as f:
        f.write("a,b,c\n1, x ,\n2\n3,y,z,extra\n")
    assert rows(T.read_lenient(spark, str(tmp_path / "a.csv.gz"), ["a", "b", "c"])) == [("1", "x", None), ("2", None, None), ("3", "y", "z")]
    df = T.read_lenient(spark, str(tmp_path / "a.csv.gz"), ["a", "b", "c"])
    T.write_csv(df, str(tmp_path / "out"))
    assert rows(spark.read.csv(str(tmp_path / "out"), header=True)) == rows(df)
    empty = T.empty_relation(spark, "a int, b string")
    assert empty.count() == 0 and empty.columns == ["a", "b"]


def test_byte_cuts(spark):
    df = spark.createDataFrame([("ab cdé f",), ("é",), (None,), ("abc",)], "s string")
    got = [r[0] for r in df.select(T.cut_bytes(F.col("s"), F.lit(3), F.lit(7))).collect()]
    assert got == ["cdé", "", None, "c"]
    assert [r[0] for r in df.select(T.cut_bytes(F.col("s"), F.lit(1), F.lit(6))).collect()][0] is None  # cuts the é


def test_layers_and_guards(spark, tmp_path):
    from skyloom.functions.astro import is_finite, tile_id
    from skyloom.functions.text import edit_limit
    from skyloom.operators.relational import col_or_null
    from skyloom.operators.tags import require_known, require_unique
    from skyloom.session import Layer

    df = spark.createDataFrame([(1, "ok"), (2, "ok")], "id int, status string")
    df.write.parquet(str(tmp_path / "t.parquet"))
    layer = Layer(spark, str(tmp_path), "core")
    assert layer.exists("t") and not layer.exists("u") and layer.columns("t") == ["id", "status"] and layer.columns("u") == []
    assert layer.attach("t") == ["core_t"] and spark.sql("SELECT count(*) FROM core_t").first()[0] == 2
    require_known(df, "status", ["ok"])
    require_unique(df, ["id"])
    for bad in (lambda: require_known(df, "status", ["fine"]), lambda: require_unique(df, ["status"])):
        with pytest.raises(ValueError):
            bad()
    assert [r[0] for r in df.select(col_or_null(df, "nope", "int")).collect()] == [None, None] and df.select(col_or_null(df, "id", "string")).first()[0] == "1"
    values = spark.createDataFrame([("vega", 1.0, 27), ("betelgeuse x", float("nan"), 0)], "s string, v double, c long")
    assert [tuple(r) for r in values.select(edit_limit(F.col("s")), is_finite(F.col("v")), tile_id(F.col("c"), 4)).collect()] == [(1, True, "d4-01b"), (3, False, "d4-000")]


def test_first_and_last_of_a_stream(spark, tmp_path):
    from skyloom.streaming.history import first_and_last

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.csv").write_text("k,2021-01-02T05:00:00\nk,2021-01-02T03:00:00\nm,2021-01-02T04:00:00\nk,2021-01-03T01:00:00\n")
    stream = spark.readStream.schema("k string, t timestamp").csv(str(tmp_path / "in"))
    query = first_and_last(stream, ["k"], "t", "1 hour").writeStream.format("memory").queryName("seen").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.sql("SELECT k, date_format(first_observed, 'dHH') AS f, date_format(last_observed, 'dHH') AS l, n_events FROM seen ORDER BY 1, 2").collect()
    assert [tuple(r) for r in got] == [("k", "203", "205", 2), ("k", "301", "301", 1), ("m", "204", "204", 1)]
