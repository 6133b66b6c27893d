import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from opsloom.sources import files as S
from opsloom.sources import local

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def _docx():
    body = (
        f"<w:document {W}><w:body><w:p><w:r><w:t>First</w:t></w:r></w:p><w:p/>"
        "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
        "<w:p><w:r><w:t>Last</w:t><w:tab/><w:t>x</w:t></w:r></w:p></w:body></w:document>"
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", body)
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "plain.txt").write_text("Region: North\r\nline two\n")
    (tmp_path / "sub" / "guide.MD").write_text("# Guide\n")
    (tmp_path / "sub" / "t.csv").write_text('a,b\n1,"x, y"\n2,z\n')
    (tmp_path / "sla_v3.json").write_text('{"b": [1, 2], "a": "é"}')
    (tmp_path / "bad.json").write_text("{oops")
    (tmp_path / "n.xml").write_text("<r><x>1</x><y/><x>2</x></r>")
    (tmp_path / "r.cfg").write_text("interface ge0\n")
    (tmp_path / "skip.exe").write_bytes(b"\x00\x01")
    (tmp_path / "latin.txt").write_bytes("é".encode("latin-1"))
    (tmp_path / "memo.docx").write_bytes(_docx())
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    (tmp_path / "scan.pdf").write_bytes(b"%PDF-1.4 not really")
    return tmp_path


def test_load_folder(spark, folder):
    rows = {r.source_path.rsplit("/", 1)[1]: r for r in S.load_documents(spark, str(folder)).collect()}
    assert sorted(rows) == ["guide.MD", "memo.docx", "n.xml", "plain.txt", "r.cfg", "sla_v3.json", "t.csv"]
    assert rows["plain.txt"].content == "Region: North\nline two\n"
    assert rows["plain.txt"].metadata == {"line_count": "3", "char_count": "23", "region": "North", "detected_as_sla": "false"}
    assert rows["plain.txt"].region == "North" and rows["plain.txt"].source_path.startswith("/")
    assert rows["t.csv"].content == "a | b\n" + "-" * 40 + "\n1 | x, y\n2 | z"
    assert rows["t.csv"].metadata["row_count"] == "2" and json.loads(rows["t.csv"].metadata["columns"]) == ["a", "b"]
    assert rows["sla_v3.json"].content == '{\n  "b": [\n    1,\n    2\n  ],\n  "a": "\\u00e9"\n}'
    assert rows["sla_v3.json"].document_type == "sla" and rows["sla_v3.json"].metadata["detected_as_sla"] == "true"
    assert json.loads(rows["sla_v3.json"].metadata["top_level_keys"]) == ["b", "a"]
    assert rows["n.xml"].metadata["root_tag"] == "r" and json.loads(rows["n.xml"].metadata["child_tags"]) == ["x", "y"]
    assert rows["memo.docx"].content == "First\n\nLast\tx\n\na | b"
    assert rows["memo.docx"].metadata["paragraph_count"] == "2" and rows["memo.docx"].metadata["has_tables"] == "true"
    assert rows["r.cfg"].document_type == "config" and rows["guide.MD"].document_type == "md"


def test_single_file_and_missing_path(spark, folder):
    (row,) = S.load_documents(spark, str(folder / "plain.txt")).collect()
    import hashlib

    assert row.doc_id == hashlib.sha256(f"{row.source_path}:{row.content[:1000]}".encode()).hexdigest()[:16]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        S.load_documents(spark, str(folder / "absent")).collect()


@pytest.mark.parametrize(
    "name, kind",
    [
        ("a.TXT", "txt"), ("a.tar.md", "md"), (".conf", None), ("x.conf", "config"), ("noext", None), ("a.exe", None),
        ("sla_v3.pdf", "sla"), ("enterprise_sla.pdf", "pdf"), ("my contract.txt", "sla"), ("service level.docx", "sla"),
        ("agreement.exe", None), ("a.sla", "sla"),
    ],
)
def test_types_by_name(one, name, kind):
    assert one(S.document_type, f"/x.dir/{name}") == [kind]


def test_region_and_uploads(one):
    assert one(S.detected_region, "REGION  b2 here", "none", "the region: nord") == ["b2", None, "nord"]
    assert one(S.accepted_upload, "text/csv", "image/png") == [True, False]


def test_large_and_unread_files_are_listed(spark, folder):
    (folder / "large.txt").write_text("x" * 5000)
    rejected = {r.source_path.rsplit("/", 1)[1]: r.reason for r in S.rejected_files(spark, str(folder), 4000).collect()}
    assert rejected == {"large.txt": "larger than the limit", "scan.pdf": "type is not read"}
    names = {r.source_path.rsplit("/", 1)[1] for r in S.load_documents(spark, str(folder), 4000).collect()}
    assert "large.txt" not in names and "plain.txt" in names


def test_unparsable_files_come_with_a_reason(spark, folder):
    reasons = {r.source_path.rsplit("/", 1)[1]: r for r in S.unparsable_files(spark, str(folder)).collect()}
    assert sorted(reasons) == ["bad.json", "broken.docx", "latin.txt"]
    assert reasons["bad.json"].reason.startswith("JSONDecodeError: ") and reasons["bad.json"].length == 5
    assert reasons["broken.docx"].reason.startswith("BadZipFile: ") and reasons["latin.txt"].reason == "not valid UTF-8"


def test_every_file_of_a_known_type_is_loaded_or_has_a_reason(spark, folder):
    (folder / "large.md").write_text("x" * 5000)
    frames = [S.load_documents(spark, str(folder), 4000), S.rejected_files(spark, str(folder), 4000), S.unparsable_files(spark, str(folder), 4000)]
    seen = [r.source_path for frame in frames for r in frame.select("source_path").collect()]
    assert len(seen) == len(set(seen))
    assert sorted(p.rsplit("/", 1)[1] for p in seen) == sorted(p.name for p in folder.rglob("*") if p.is_file() and p.name != "skip.exe")


def test_all_scans_of_written_files_share_one_listing(spark, monkeypatch):
    from opsloom.plans import all_queries

    listed, chosen = [], S.list_files
    monkeypatch.setattr(S, "list_files", lambda *a: listed.append(a) or chosen(*a))
    rows = all_queries()[0]["load_written_files"](spark, "/root/testdata/sf0.001").collect()
    assert len(listed) == 1 and {r.document_type for r in rows} == {"txt", "csv", "json", "xml"}


def test_files_are_read_with_their_reasons(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\r\ntwo")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "c.xml").write_text("<a><b/></a>")
    (tmp_path / "d.JSON").write_text("{")
    (tmp_path / "e.exe").write_text("no")
    rows = {r.source_path[-5:]: r for r in S.read_files(spark, str(tmp_path)).collect()}
    assert sorted(rows) == [".JSON", "a.txt", "b.txt", "c.xml"]
    assert rows["a.txt"].content == "one\ntwo" and rows["a.txt"].reason is None and rows["a.txt"].length == 8
    assert rows["b.txt"].content is None and rows["b.txt"].reason == "not valid UTF-8"
    assert rows["c.xml"].reason is None and rows[".JSON"].reason.startswith("JSONDecodeError")


ODD = [
    (0, "en", 3, "a", "one\ntwo"), (1, None, None, "a", None), (2, "", 0, "a", ""), (3, "a&b<c>\"'", 1, "a", "\r\nx\r"), (399, " x\r\ny ", 1, "a", "é😀"),
    (400, "a,b", 2, "b/c d=%", "x"), (400, 'q"u', 2, "b/c d=%", "x"), (5, "l", 1, None, "none"), (None, "n", 1, "a", "no id"), (None, None, None, "a", "no row"),
    (801, "#\x7f", 9, "e:[x]", "y" * 70_000),
]


@pytest.fixture
def odd(spark, tmp_path):
    docs = spark.createDataFrame(ODD, "doc_id long, lang string, n_chars long, source string, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def _loaded(spark, folder):
    from opsloom.plans import all_queries

    return sorted(map(str, all_queries()[0]["load_written_files"](spark, folder).collect()))


def test_files_written_and_read_by_tasks_are_those_of_the_writers(spark, odd, monkeypatch):
    """Every file system but the mounted one is left to Spark, with the same rows."""
    own = _loaded(spark, odd)
    monkeypatch.setattr(local, "local_path", lambda *a: None)
    assert own == _loaded(spark, odd) and len(own) == 20


def test_no_writer_or_listing_of_hadoop_for_mounted_files(spark, odd, monkeypatch):
    from pyspark.sql import DataFrameReader
    from pyspark.sql.readwriter import DataFrameWriter

    def fail(*a, **k):
        raise AssertionError("a process for each file, and a listing in the driver")

    for name in ("text", "csv", "json", "xml"):
        monkeypatch.setattr(DataFrameWriter, name, fail)
    monkeypatch.setattr(DataFrameReader, "format", fail)
    assert _loaded(spark, odd)


def test_a_task_reads_a_bounded_number_of_files(spark, tmp_path, monkeypatch):
    for i in range(40):
        (tmp_path / f"d{i % 3}" / f"e{i % 5}").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"d{i % 3}" / f"e{i % 5}" / f"f{i}.txt").write_text("x" * (i + 1))
    monkeypatch.setattr(local, "FILES_A_TASK", 3)
    listed = S.list_files(spark, f"{tmp_path}")
    read = S.scan_files(spark, str(tmp_path), ["txt"], files=listed)
    held = [r["count"] for r in read.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(held) == 40 and read.rdd.getNumPartitions() == 14
    assert sorted(len(r.raw) for r in read.collect()) == list(range(1, 41))
    monkeypatch.setattr(local, "FILES_A_TASK", 512)
    monkeypatch.setattr(local, "BYTES_A_TASK", 110)
    assert S.scan_files(spark, str(tmp_path), ["txt"], files=listed).rdd.getNumPartitions() == 8


def test_listings_leave_out_what_spark_leaves_out(spark, tmp_path):
    for name in ("a.txt", "_SUCCESS.txt", "_x=1.txt", ".b.txt", "c.txt._COPYING_", "_metadata.txt", "D.TXT", "e.exe", "é f%20#.md", ".txt"):
        (tmp_path / name).write_text(name)
    (tmp_path / "empty.txt").write_text("")
    for name in ("_tmp", ".git", "k=v", "_k=v", "x y", "_metadata", "z._COPYING_"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "in.csv").write_text("a\n")
    (tmp_path / "gone.txt").symlink_to(tmp_path / "nothing")
    (tmp_path / "link").symlink_to(tmp_path / "k=v")
    own = {(r.path, r.length) for r in S.list_files(spark, f"{tmp_path}/").collect()}
    spark_own = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", S._glob(S.EXTENSION_TYPES.values()))
    assert own == {(r.path.removeprefix("file:"), r.length) for r in spark_own.load(str(tmp_path)).select("path", "length").collect()}
    (one,) = S.list_files(spark, f"file://{tmp_path}/a.txt").collect()
    assert (one.path, one.length) == (f"{tmp_path}/a.txt", 5)
    # a pattern of paths is Spark's
    assert {r.source_path for r in S.load_documents(spark, f"{tmp_path}/*.txt").collect()} >= {f"{tmp_path}/a.txt"}


def test_a_repeated_task_puts_its_file_in_the_same_place(spark, tmp_path):
    rows = spark.createDataFrame([("g", "1\n"), ("g", "2\n"), ("h/i", "3\n")], "k string, l string").coalesce(1)
    for _ in range(2):
        local.write_groups(rows, str(tmp_path), ".txt", "head\n", "tail")
    files = {str(p.relative_to(tmp_path)): p.read_text() for p in tmp_path.rglob("*") if p.is_file()}
    assert files == {"k=g/part-00000.txt": "head\n1\n2\ntail", "k=h%2Fi/part-00000.txt": "head\n3\ntail"}
