"""Text files that break while they are read give error rows and end no job."""

import gzip

from pagelake import sources as S

HEAD = "filename,startx,starty,endx,endy,text\n"


def errors_of(frame):
    return sorted((r["file_no"].rsplit("/", 1)[1], r["line"], r["error_code"]) for r in frame.collect())


def test_broken_csv_files(spark, tmp_path):
    folder = tmp_path / "texts.csv"
    folder.mkdir()
    (folder / "a.csv").write_text(HEAD + "p1.png,1,2,3,4,one\n", encoding="utf-8")
    (folder / "b.csv.gz").write_bytes(gzip.compress((HEAD + "p2.png,1,2,3,4,two\n" * 5000).encode())[:60])
    (folder / "c.csv.gz").write_bytes(b"no archive at all")
    (folder / "d.csv").write_bytes((HEAD + "p3.png,1,2,3,4,").encode() + b"\xff\xfe\n")
    (folder / "e.csv").write_bytes(b"")
    (folder / "f.csv.gz").write_bytes(gzip.compress((HEAD + "p4.png,5,6,7,8,four\n").encode()))
    rows, errors = S.read_ocr(spark, str(folder))
    assert sorted(r["filename"] for r in rows.collect()) == ["p1.png", "p4.png"]
    assert errors_of(errors) == [("b.csv.gz", -1, "OS_ERROR"), ("c.csv.gz", -1, "OS_ERROR"), ("d.csv", -1, "OTHER_ERROR")]


def test_broken_section_files(spark, tmp_path):
    folder = tmp_path / "texts.txt"
    folder.mkdir()
    (folder / "a.txt").write_text("p1.png:\none\ntwo\n", encoding="utf-8")
    (folder / "b.txt.gz").write_bytes(b"\x1f\x8b broken")
    (folder / "c.txt").write_bytes(b"p2.png:\n\xc3\x28\n")
    rows, errors = S.read_ocr(spark, str(folder), str(tmp_path / "gone.txt"), str(tmp_path / "x.md"))
    assert sorted(r["text"] for r in rows.collect()) == ["one", "two"]
    assert errors_of(errors) == [("b.txt.gz", -1, "OS_ERROR"), ("c.txt", -1, "OTHER_ERROR"), ("gone.txt", -1, "OS_ERROR"), ("x.md", -1, "INVALID_FORMAT")]
