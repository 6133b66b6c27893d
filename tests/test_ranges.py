"""Byte ranges of files: every record once, whatever the ranges, and a reason for what is not read."""

import csv
import io
import json
import random

import pytest

from opsloom.sources.ranges import file_statistics, read_ranges, rejected_pieces


def whole(pieces, name):
    own = sorted((r for r in pieces if r.source_path.endswith(name)), key=lambda r: r.start)
    return "".join(r.content for r in own), own


def csv_text(rows, end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize("size", [7, 64, 1000, 100_000])
def test_every_record_once(spark, tmp_path, size):
    draw = random.Random(4)
    lines = ["x" * draw.randint(0, 30) + draw.choice(["é", "", "\t"]) for _ in range({7: 15, 64: 60}.get(size, 400))]
    (tmp_path / "a.txt").write_text("\n".join(lines), encoding="utf-8")
    (tmp_path / "b.md").write_text("\n".join(lines) + "\n", encoding="utf-8")
    rows = [["id", "said"]] + [[str(i), draw.choice(["plain", 'a "quoted" word', "two\nlines, with comma", '"', "\n\n"])] for i in range(len(lines))]
    (tmp_path / "c.csv").write_text(csv_text(rows), newline="")
    records = [{"id": i, draw.choice("abc"): "x\n"} for i in range(len(lines))]
    (tmp_path / "d.jsonl").write_text("\n".join(map(json.dumps, records)) + "\n")
    pieces = read_ranges(spark, str(tmp_path), range_bytes=size, piece_bytes=500)
    got = pieces.collect()
    assert whole(got, "a.txt")[0] == "\n".join(lines) and whole(got, "b.md")[0] == "\n".join(lines) + "\n"
    assert list(csv.reader(io.StringIO(whole(got, "c.csv")[0]))) == rows
    assert [json.loads(x) for x in whole(got, "d.jsonl")[0].splitlines()] == records
    stats = {r.source_path.rsplit("/", 1)[1]: r for r in file_statistics(pieces).collect()}
    n = len(lines)
    assert {k: (r.format, r.records, list(r.reasons)) for k, r in stats.items()} == {
        "a.txt": ("text", n - 1, []), "b.md": ("text", n, []), "c.csv": ("csv", n, []), "d.jsonl": ("json", n, []),
    }
    assert stats["c.csv"].columns == ["id", "said"] and stats["d.jsonl"].columns == ["a", "b", "c", "id"]
    assert stats["a.txt"].chars == len("\n".join(lines))
    assert size > 10_000 or stats["a.txt"].ranges > 1


def test_reasons(spark, tmp_path):
    (tmp_path / "bad.txt").write_bytes(b"fine\n\xff\xfe\n")
    (tmp_path / "bad.csv").write_text('id,said\n1,"open')
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\nnot json\n{"b": 2}\n')
    (tmp_path / "page.pdf").write_bytes(b"%PDF")
    (tmp_path / "picture.png").write_bytes(b"x")
    (tmp_path / "empty.txt").write_text("")
    deep = tmp_path / "deep"
    deep.mkdir()
    (deep / "crlf.txt").write_bytes(b"a\r\nb\r\n")
    pieces = read_ranges(spark, str(tmp_path))
    reasons = {r.source_path.rsplit("/", 1)[1]: r.reason for r in rejected_pieces(pieces).collect()}
    assert reasons["bad.txt"] == "not UTF-8 at byte 5" and reasons["bad.csv"].startswith("not CSV")
    assert reasons["bad.jsonl"] == "not JSON: Expecting value"
    assert (reasons["page.pdf"], reasons["picture.png"]) == ("read as a whole file", "type is not known")
    assert set(reasons) == {"bad.txt", "bad.csv", "bad.jsonl", "page.pdf", "picture.png"}
    got = pieces.collect()
    assert whole(got, "crlf.txt")[0] == "a\nb\n" and whole(got, "empty.txt")[0] == ""
    assert {r.source_path.rsplit("/", 1)[1]: r.records for r in file_statistics(pieces).collect()}["bad.jsonl"] == 2
    with pytest.raises(Exception, match="FileNotFoundError"):
        read_ranges(spark, str(tmp_path / "nothing")).collect()


def test_one_file_by_uri(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    for scheme in ("file://", "file:", ""):
        got = read_ranges(spark, f"{scheme}{tmp_path}/a.txt", range_bytes=4).collect()
        assert sorted(r.content for r in got) == ["one\n", "two\n"]
