"""Source archives read in a stream, broken and hostile ones included."""

import io
import os
import tarfile
import tempfile

from tablemine.sources.archives import archive_files, dealt, inside, read_archives


def _archive(path, files, links=(), cut=None):
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as tar:
        for name, data in files:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
        for name, target in links:
            info = tarfile.TarInfo(name)
            info.type, info.linkname = tarfile.SYMTYPE, target
            tar.addfile(info)
    with open(path, "wb") as f:
        f.write(buffer.getvalue()[:cut])


def test_archives(spark):
    root = tempfile.mkdtemp(prefix="tablemine-archives-")
    os.mkdir(f"{root}/2024")
    _archive(f"{root}/2401.00001.tar.gz", [("main.tex", b"a\xffb"), ("./sec/x.tex", "é".encode()), ("fig.png", b"x" * 99), ("r.bib", b"")])
    _archive(f"{root}/2024/2402.00002.tar.gz", [("../out.tex", b"no"), ("/etc/x.tex", b"no"), ("a/../../y.tex", b"no"), ("a/../z.tex", b"yes")],
             links=[("l.tex", "/etc/passwd")])
    _archive(f"{root}/cut.tar.gz", [("first.tex", os.urandom(200_000)), ("second.tex", os.urandom(200_000))], cut=300_000)
    for name, data in (("none", b""), ("page", b"<html>"), ("one", __import__("gzip").compress(b"\\documentclass{x}"))):
        with open(f"{root}/{name}.tar.gz", "wb") as f:
            f.write(data)
    with open(f"{root}/notes.txt", "w") as f:
        f.write("x")
    before = sorted(os.listdir(root))
    rows = read_archives(spark, root, partitions=3)
    assert rows.rdd.getNumPartitions() == 3
    got = {}
    for r in rows.collect():
        got.setdefault(r.paper_id, []).append((r.rel_path, None if r.content is None else len(r.content), r.error))
    assert sorted(got["2401.00001"]) == [("main.tex", 3, None), ("r.bib", 0, None), ("sec/x.tex", 2, None)]
    assert sorted(got["2402.00002"], key=str) == sorted([
        ("../out.tex", None, "path leaves the folder"), ("/etc/x.tex", None, "path leaves the folder"),
        ("a/../../y.tex", None, "path leaves the folder"), ("z.tex", 3, None), ("l.tex", None, "not a regular file")], key=str)
    assert got["cut"][0] == ("first.tex", 200_000, None) and got["cut"][-1][0] is None
    assert all(got[k][0][2].startswith("broken archive") and len(got[k]) == 1 for k in ("none", "page", "one"))
    text = {(r.paper_id, r.rel_path): r.content for r in archive_files(rows.filter("paper_id like '24%'")).collect()}
    assert text["2401.00001", "main.tex"] == "ab" and text["2401.00001", "sec/x.tex"] == "é"
    assert sorted(os.listdir(root)) == before  # nothing is unpacked
    assert read_archives(spark, tempfile.mkdtemp()).count() == 0


def test_paths_and_deal():
    assert [inside(x) for x in ("a/b.tex", "./a", "..", ".", "C:\\x.tex", "a\\..\\..\\x")] == ["a/b.tex", "a", None, None, None, None]
    parts = dealt([(100, "big"), *((10, f"s{k}") for k in range(10))], 2)
    assert sorted(map(len, parts)) == [1, 10]


def test_partitions_hold_no_names(tmp_path):
    import pickle
    import random

    import pytest

    from tablemine.sources.archives import ArchiveReader
    (tmp_path / "deep" / "er").mkdir(parents=True)
    sizes = random.Random(1)
    for k in range(400):
        _archive(tmp_path / ("deep/er" if k % 3 else "") / f"name{k}.tar.gz", [("a.tex", sizes.randbytes(sizes.randrange(3000)))])
    reader = ArchiveReader({"path": str(tmp_path), "partitions": "4"})
    parts = reader.partitions()
    assert len(parts) == 4 and not any(b"name" in pickle.dumps(p) for p in parts)
    read = [list(reader.read(p)) for p in parts]
    assert sorted(row[0] for rows in read for row in rows) == sorted(f"name{k}" for k in range(400))
    held = [sum(len(row[2]) for row in rows) for rows in read]
    assert max(held) < 1.1 * min(held)
    (tmp_path / "name0.tar.gz").unlink()
    with pytest.raises(FileNotFoundError):
        [list(reader.read(p)) for p in parts]
