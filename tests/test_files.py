"""Folders of files: scanning, decoding by charset, streaming into the index."""

import pytest
from pyspark.sql import functions as F

from corpusloom.plans.ingest import Index, load_files
from corpusloom.sources import charsets
from corpusloom.sources.documents import scan_files
from corpusloom.streaming.activity import stream_folder

ARABIC = "هذا نص عربي طويل يحتوي على كلمات كثيرة ومفيدة للقراءة في المدرسة"
WESTERN = "Où est-ce qu'il a caché la clé ? Größe, señor, naïve façade"
PAGE = "<html><head><meta charset={}></head><body><article><h1>T</h1><p>{}</p></article></body></html>"


@pytest.mark.parametrize(
    ("raw", "declares", "text", "name"),
    [
        (b"plain", True, "plain", "utf-8"),
        (b"", True, "", "utf-8"),
        (ARABIC.encode(), True, ARABIC, "utf-8"),
        (ARABIC.encode("windows-1256"), True, ARABIC, "windows-1256"),
        (WESTERN.encode("windows-1252"), True, WESTERN, "windows-1252"),
        (WESTERN.encode("utf-16"), True, WESTERN, "utf-16"),
        (b"\xef\xbb\xbf" + WESTERN.encode(), True, WESTERN, "utf-8-sig"),
        (b"charset=windows-1256 " + ARABIC.encode("windows-1256"), True, "charset=windows-1256 " + ARABIC, "windows-1256"),
        (b'CHARSET="latin-1" \xe9', True, 'CHARSET="latin-1" é', "latin-1"),
        (b"charset=utf-8 \xff", True, "charset=utf-8 �", "utf-8"),
        (b"charset=klingon \xe9t\xe9", True, "charset=klingon été", "windows-1252"),
        (b"charset=base64 text", True, "charset=base64 text", "utf-8"),
        (b" " * 4096 + b"charset=utf-16 x", True, " " * 4096 + "charset=utf-16 x", "utf-8"),
        (b"charset=latin-1 " + "é".encode(), False, "charset=latin-1 é", "utf-8"),
    ],
)
def test_decoding(spark, raw, declares, text, name):
    assert charsets.decode(raw, declares) == (text, name)
    got = spark.createDataFrame([(bytearray(raw),), (None,)], "c binary").select(charsets.decoded(F.col("c"), declares).alias("v")).collect()
    assert tuple(got[0]["v"]) == (text, name) and got[1]["v"] is None


def test_pages_and_texts_of_several_charsets(spark):
    rows = [(f"in/{name}.html", PAGE.format(name, text).encode(name)) for name, text in (("windows-1256", ARABIC), ("iso-8859-1", WESTERN), ("utf-8", ARABIC))]
    rows += [("in/a.txt", ARABIC.encode("windows-1256")), ("in/b.md", WESTERN.encode("utf-16"))]
    pages, _ = load_files(spark.createDataFrame(rows, "path string, content binary"))
    got = {r["source_path"]: r["raw_text"].removeprefix("T\n") for r in pages.collect()}
    assert {k: v.splitlines()[-1] for k, v in got.items()} == {"in/windows-1256.html": ARABIC, "in/iso-8859-1.html": WESTERN, "in/utf-8.html": ARABIC, "in/a.txt": ARABIC, "in/b.md": WESTERN}


def test_scan_order_and_extensions(spark, tmp_path):
    for name in ("B.TXT", "a.txt", "sub/C.Html", "sub/deep/d.md", "e.pdf", "noextension", "f.txt.bak"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    got = scan_files(spark, f"file://{tmp_path}", ["txt", ".HTML", "md"]).collect()
    assert [bytes(r["content"]).decode() for r in got] == ["a.txt", "B.TXT", "sub/C.Html", "sub/deep/d.md"]
    assert scan_files(spark, f"file://{tmp_path}", ["docx"]).collect() == [] and scan_files(spark, f"file://{tmp_path}/none", ["txt"]).collect() == []


def test_a_folder_streams_into_the_index(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    long = "The quick brown fox jumps over the lazy dog while twelve other animals watch number {}. " * 6
    for k in range(5):
        (folder / f"{k}.txt").write_text(long.replace("{}", str(k)))
    (folder / "short.txt").write_text("too short")
    index = Index(spark, f"file://{tmp_path}/index", buckets=4)

    def run():
        stream_folder(spark, f"file://{folder}", index, f"file://{tmp_path}/checkpoint", files_a_batch=2)
        return index.tables().number, {r["file_hash"] for r in index.manifest().collect()}

    number, files = run()
    assert len(files) == 5 and index.vectors().count() == index.manifest().count()
    assert run() == (number, files)  # nothing new
    (folder / "copy.TXT").write_text(long.replace("{}", "3"))
    (folder / "new.md").write_text(long.replace("{}", "9"))
    (folder / "arabic.html").write_bytes(PAGE.format("windows-1256", ARABIC * 3).encode("windows-1256"))
    again, more = run()
    assert again > number and files < more and len(more) == 7
