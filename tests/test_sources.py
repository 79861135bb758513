from __future__ import annotations

import datetime as dt
import io
import struct
import time
import zipfile

import pytest

from polka.operators import catalog
from polka.sources import images, spreadsheet
from polka.sources.delimited import FileError, read_delimited
from polka.sources.extract import ProviderError, recognise
from polka.streaming.limits import Session, rate_limit_stream, session_stream


def test_cp1251_csv_and_tsv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes("sku;наименование;цена\n001;Молоко;1 234,56\n;;\n".encode("cp1251"))
    r = catalog.load_catalog(read_delimited(spark, str(p))).first()
    assert (r["sku"], r["name"], r["sale_price"]) == ("001", "Молоко", 1234.56)
    p = tmp_path / "b.tsv"
    p.write_bytes("﻿sku\tнаименование\tцена\n0007\tКефир\t89,90\n".encode())
    r = catalog.load_catalog(read_delimited(spark, str(p))).first()
    assert (r["sku"], r["sale_price"]) == ("0007", 89.9)
    (tmp_path / "c.csv").write_bytes(b"")
    with pytest.raises(FileError):
        read_delimited(spark, str(tmp_path / "c.csv"))


def test_workbooks(spark, tmp_path):
    p = tmp_path / "a.xlsx"
    p.write_bytes(spreadsheet.workbook({"S": [["sku", "name", "price", None], ["0001", "Товар <&>", 10], [None, None, None]]}))
    r = catalog.load_catalog(spreadsheet.read_sheet(spark, str(p))).first()
    assert (r["sku"], r["name"], r["sale_price"]) == ("0001", "Товар <&>", 10.0)
    (tmp_path / "b.xlsx").write_bytes(b"sku,name\n1,2")
    with pytest.raises(FileError, match="format"):
        spreadsheet.read_sheet(spark, str(tmp_path / "b.xlsx"))
    (tmp_path / "c.xls").write_bytes(spreadsheet.OLE + b"0" * 100)
    with pytest.raises(FileError, match="binary"):
        spreadsheet.read_sheet(spark, str(tmp_path / "c.xls"))


def test_ods(spark, tmp_path):
    out = io.BytesIO()
    ns = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"'
    cell = lambda x: f"<table:table-cell><text:p>{x}</text:p></table:table-cell>"
    rows = "".join("<table:table-row>" + "".join(map(cell, r)) + "</table:table-row>" for r in (("sku", "name", "price"), ("01", "Сыр", "5,5")))
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/vnd.oasis.opendocument.spreadsheet")
        z.writestr("content.xml", f"<office:document-content {ns}><office:body><office:spreadsheet><table:table>{rows}</table:table></office:spreadsheet></office:body></office:document-content>")
    (tmp_path / "a.ods").write_bytes(out.getvalue())
    assert catalog.load_catalog(spreadsheet.read_sheet(spark, str(tmp_path / "a.ods"))).first()["sale_price"] == 5.5


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", w, h) + b"\x08\x02\0\0\0"


def test_images_and_archives(spark, tmp_path):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w", zipfile.ZIP_DEFLATED) as f:
        f.writestr("../../shop/photo.png", png(32, 24))
        f.writestr("other/photo.png", png(9000, 9000))
        f.writestr("note.txt", "x")
    (tmp_path / "a.zip").write_bytes(z.getvalue())
    (tmp_path / "b.png").write_bytes(png(10, 20))
    (tmp_path / "c.jpg").write_bytes(b"no image")
    bomb = io.BytesIO()
    with zipfile.ZipFile(bomb, "w", zipfile.ZIP_DEFLATED) as f:
        f.writestr("a.png", b"\0" * (2 * 2**20))
    (tmp_path / "d.zip").write_bytes(bomb.getvalue())
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = {(r["name"], r["problem"], r["width"]) for r in images.collect_images(files).collect()}
    assert got == {("photo.png", None, 32), ("photo.png", "pixels", 9000), ("b.png", None, 10), ("c.jpg", "format", None), ("d.zip", "compression ratio", None)}
    members = spreadsheet.zip_members(files.where("path like '%.zip'")).collect()
    assert {r["problem"] for r in members} == {None, "compression ratio"} and len(members) == 4
    assert images.unique_names(["a.jpg", "A.jpg", "a_2.jpg", "a.jpg"]) == ["a.jpg", "A_2.jpg", "a_2_2.jpg", "a_3.jpg"]
    assert images.safe_name("..\\x/фо\0то.JPG") == "фото.jpg" and images.safe_name("") == "photo"


def test_report_workbook_layout(spark):
    rep = spark.createDataFrame([("1", "Сыр", 1.5)], "sku string, name string, price double")
    lines = spark.createDataFrame([("total_items", 1.0)], "label string, value double")
    rows = spreadsheet.xlsx_rows(spreadsheet.report_workbook(rep, lines, "Report", "meta"))
    assert rows[0] == ["Report"] and rows[3] == ["sku", "name", "price"] and rows[4] == ["1", "Сыр", "1.5"]


def test_breaker_stops_a_partition(spark):
    items = spark.createDataFrame([(i, f"{i}.jpg", bytearray(b"x")) for i in range(8)], "idx bigint, filename string, content binary").coalesce(1)

    def call(name, data):
        if name in ("0.jpg", "2.jpg"):
            raise ValueError
        if name == "1.jpg":
            return "{}"
        raise ProviderError(500, 0.0)

    got = [r["error_code"] for r in recognise(items, call, sleep=lambda s: None).orderBy("idx").collect()]
    assert got == ["worker_error", None, "worker_error", "provider_error", "provider_error", "provider_error", "circuit_open", "circuit_open"]


def test_session_rules():
    s = Session(10.0, 2, 5, 8)
    assert [s.add(5, 0.0), s.add(9, 0.0), s.add(4, 0.0), s.add(3, 9.9)] == ["ok", "item_bytes", "session_bytes", "ok"]
    assert s.add(1, 9.9) == "item_count" and s.take(10.0) == 2 and s.add(1, 11.0) == "session_processing"
    assert s.release() and s.add(1, 12.0) == "ok" and s.add(1, 22.0, expected=s.version) == "session_closed"


def stream(spark, tmp_path, rows, schema, op, name, expect):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name))
    df = spark.readStream.schema(schema).parquet(str(tmp_path / name))
    q = op(df).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(processingTime="200 milliseconds").start()
    deadline = time.time() + 60  # a stream with timers never runs out of batches: wait for the rows
    while time.time() < deadline and spark.table(name).count() < expect:
        time.sleep(0.5)
    q.stop()
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [(i, u, at(t)) for i, (u, t) in enumerate([(1, 0), (1, 1), (1, 2), (2, 2), (1, 10)])]
    got = {r["event_id"]: r["accepted"] for r in stream(spark, tmp_path, rows, "event_id bigint, user_id bigint, ts timestamp", lambda df: rate_limit_stream(df, 2, 10.0), "limits", 5)}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True}
    rows = [(1, at(0), 5), (1, at(1), 99), (1, at(2), 3), (None, at(2), 3)]
    got = [r["outcome"] for r in stream(spark, tmp_path, rows, "user_id bigint, ts timestamp, bytes bigint", lambda df: session_stream(df, 100.0, 5, 10, 20), "uploads", 3)]
    assert got == ["ok", "item_bytes", "ok"]
