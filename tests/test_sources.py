import struct
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tagloom.functions import ids
from tagloom.sources import files, store
from tagloom.streaming import feeds


def png(width=64, height=32):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", width, height, 8, 2, 0, 0, 0) + b"\0" * 8


def flac(tags, image=None):
    def block(kind, body, last=False):
        return bytes([kind | 0x80 * last]) + len(body).to_bytes(3, "big") + body

    info = b"\0" * 10 + (44100 << 4).to_bytes(3, "big") + (44100).to_bytes(5, "big") + b"\0" * 16
    comments = [f"{k}={v}".encode() for k, v in tags]
    vorbis = struct.pack("<I", 0) + struct.pack("<I", len(comments)) + b"".join(struct.pack("<I", len(c)) + c for c in comments)
    picture = struct.pack(">II", 3, 9) + b"image/png" + struct.pack(">I", 0) + b"\0" * 16 + struct.pack(">I", len(image or b"")) + (image or b"")
    return b"fLaC" + block(0, info) + (block(6, picture) if image else b"") + block(4, vorbis, True) + b"FRAMES"


def test_read_tags(spark):
    frame = lambda name, value: name + len(value).to_bytes(4, "big") + b"\0\0" + value
    body = frame(b"TIT2", b"\x03Song") + frame(b"TPE1", b"\x00Act")
    id3 = b"ID3\x03\0\0" + bytes([0, 0, len(body) >> 7, len(body) & 127]) + body + b"AUDIO" + b"TAG" + b"\0" * 125
    wave = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", 8000) + b"\0" * 8000
    rows = [("a.flac", flac([("TITLE", "Song"), ("BARCODE", "012345678905"), ("barcode", "x")], png())), ("b.mp3", id3), ("c.wav", b"RIFF" + struct.pack("<I", len(wave) + 4) + b"WAVE" + wave), ("d.flac", flac([])[:50]), ("e", b"")]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")
    out = files.read_tags(df)
    got = {r["path"]: r for r in out.collect()}
    assert (got["a.flac"]["duration_ms"], got["a.flac"]["picture_width"], got["a.flac"]["picture_depth"], got["a.flac"]["audio_bytes"]) == (1000, 64, 24, 6)
    assert got["b.mp3"]["tags"] == {"title": ["Song"], "artist": ["Act"]} and got["b.mp3"]["audio_bytes"] == 5
    assert got["c.wav"]["duration_ms"] == 1000 and got["d.flac"]["status"] != "ok" and got["e"]["status"] != "ok"
    code = files.identifier(F.col("tags"), ["barcode"], ids.barcode, lambda c: F.lpad(c, 14, "0"))
    row = out.where("path = 'a.flac'").select(files.tag(F.col("tags"), "name", "title").alias("t"), code.alias("c")).first()
    assert row["t"] == "Song" and row["c"]["value"] == "012345678905" and row["c"]["warnings"] == ["malformed"]


def test_image_header():
    assert files.image_header(png()) == ("image/png", 64, 32, 24)
    jpeg = b"\xff\xd8\xff\xc0" + struct.pack(">HBHHB", 17, 8, 20, 30, 3) + b"\0" * 9
    assert files.image_header(jpeg) == ("image/jpeg", 30, 20, 24)
    assert files.image_header(b"") is None and files.image_header(b"\xff\xd8") is None


def test_listing(spark, tmp_path):
    for name in ("a/x.mp3", "a/b/y.FLAC", "a/z.txt", ".h/q.mp3", "a/.x.artwork-transaction-1.json"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    (tmp_path / "a/link.mp3").symlink_to(tmp_path / "a/x.mp3")
    got = {(r["path"].removeprefix(str(tmp_path)), r["kind"]) for r in files.listing(spark, str(tmp_path)).collect()}
    assert got == {("/a/x.mp3", "audio"), ("/a/b/y.FLAC", "audio"), ("/a/.x.artwork-transaction-1.json", "journal")}


def test_reports_and_cache(spark, tmp_path):
    df = spark.createDataFrame([(2, "x"), (1, None)], "b long, a string")
    store.write_report(df, str(tmp_path / "r.json"))
    assert spark.read.json(str(tmp_path / "r.json")).count() == 2
    with pytest.raises(Exception):
        store.write_report(df, str(tmp_path / "r.json"))
    with pytest.raises(ValueError):
        store.write_report(df, str(tmp_path / "r.mp3"), audio_endings=["mp3"])
    store.write_cache(df, str(tmp_path / "c"), "b", 1)
    store.write_cache(spark.createDataFrame([(2, "y")], "b long, a string"), str(tmp_path / "c"), "b", 1)
    got = {r["b"]: r["a"] for r in store.read_cache(spark, str(tmp_path / "c"), 1, F.current_timestamp()).collect()}
    assert got == {2: "y", 1: None} and store.read_cache(spark, str(tmp_path / "c"), 2, F.current_timestamp()).count() == 0
    urls = spark.createDataFrame([("https://x/100x100bb.jpg",), ("https://x/odd",), (None,)], "u string").select(store.image_urls(F.col("u"))).collect()
    assert [len(u[0]) for u in urls] == [4, 1, 0]


def test_streams(spark, tmp_path):
    rows = [("a", 1, datetime(2024, 1, 1)), ("a", 2, datetime(2024, 1, 2)), ("b", 3, datetime(2024, 1, 2))]
    schema = "path string, track_id long, ingested_at timestamp"
    table = spark.createDataFrame(rows, schema)
    assert sorted(r["track_id"] for r in feeds.first_deliveries(table, "path", "ingested_at").collect()) == [1, 3]
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = feeds.first_deliveries(stream, "path", "ingested_at").writeStream.format("memory").queryName("first").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("first").count() == 2
    assert feeds.arrivals(table, "ingested_at", "path").count() == 3
    now = spark.createDataFrame([("a", 5)], "path string, size long")
    then = spark.createDataFrame([("a", 4), ("b", 1)], "path string, size long")
    assert {tuple(r) for r in feeds.changed(then, now, "path", "size").collect()} == {("a", "changed"), ("b", "gone")}
