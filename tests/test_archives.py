"""ZIP members by byte range, and drops discovered by their schema."""

from __future__ import annotations

import random
import zipfile

import pytest

from waymark.sources import archives
from waymark.streaming import runs


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    path = tmp_path_factory.mktemp("zip") / "big.kmz"
    noise = random.Random(1).randbytes(3_000_000)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("images/", "")
        z.writestr("images/a.jpg", noise)
        with z.open("doc.kml", "w", force_zip64=True) as f:
            f.write(b"<kml>" + b"x" * 5000 + b"</kml>")
        z.writestr("stored.txt", "as it is", zipfile.ZIP_STORED)
        z.writestr("empty.txt", "")
        z.writestr("ünïcode/näme.kml", "<kml/>")
    return str(path), noise


def test_members_and_their_bytes(spark, archive):
    path, noise = archive
    rows = {r["name"]: r for r in archives.zip_members(spark, path).collect()}
    assert archives.zip_members(spark, path, path).count() == 2 * len(rows)
    assert set(rows) == {"images/a.jpg", "doc.kml", "stored.txt", "empty.txt", "ünïcode/näme.kml"}
    assert bytes(rows["images/a.jpg"]["content"]) == noise and bytes(rows["stored.txt"]["content"]) == b"as it is" and bytes(rows["empty.txt"]["content"]) == b""
    assert bytes(rows["doc.kml"]["content"]).startswith(b"<kml>xx") and rows["doc.kml"]["size"] == 5011
    assert archives.members(path)[1] < 2000


def test_a_filter_on_the_name_reads_that_member_only(spark, archive):
    path, _ = archive
    read = archives.zip_members(spark, path)
    (r,) = read.where("name = 'doc.kml'").collect()
    assert r["bytes_read"] == archives.LOCAL_HEADER + r["packed"] < 300
    assert {r["name"] for r in read.where("name like '%.kml' and size > 10").collect()} == {"doc.kml"}
    assert read.where("name = 'absent'").count() == 0
    assert {r["name"] for r in read.where("name in ('doc.kml', 'stored.txt')").collect()} == {"doc.kml", "stored.txt"}


def test_what_is_broken_is_told(archive, tmp_path):
    path, _ = archive
    doc = next(m for m in archives.members(path)[0] if m.name == "doc.kml")
    with pytest.raises(ValueError, match="check sum"):
        archives.content(archives.Member(**{**doc.__dict__, "crc": 1}))
    with pytest.raises(EOFError):
        archives.content(archives.Member(**{**doc.__dict__, "packed": 10**9}))


def test_drops_join_by_their_schema(spark, tmp_path):
    folder, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    folder.mkdir()
    (folder / "waypoints_a.csv").write_text("# a comment\nname,lon,lat,note\nSchool,148.1,-9.2,open\n\"A, B\",148.2,-9.3,\n")
    (folder / "waypoints_rivers.csv").write_text("name,lon,lat,recorded\nFord,148.1,-9.2,2026-01-01\n")
    (folder / "empty.csv").write_text("# nothing yet\n")
    columns = ("name", "note", "lon", "lat", "photos")
    run = lambda: runs.discover(spark, str(folder), out, cp, columns).awaitTermination(180)
    run()
    rows = lambda: sorted((r["_drop"], r["name"], r["note"], r["lon"], r["photos"]) for r in spark.read.parquet(f"{out}/rows").collect())
    first = [("waypoints_a.csv", "A, B", None, "148.2", None), ("waypoints_a.csv", "School", "open", "148.1", None)]
    assert rows() == first
    run()  # a restart without new files
    assert rows() == first
    (folder / "waypoints_b.csv").write_text("photos,note,name\n3,closed,Aid post\n")
    run()
    assert rows() == [*first, ("waypoints_b.csv", "Aid post", "closed", None, "3")]
    seen = {r["path"].rsplit("/", 1)[-1]: r["joins"] for r in spark.read.parquet(f"{out}/files").collect()}
    assert seen == {"waypoints_a.csv": True, "waypoints_rivers.csv": False, "empty.csv": False, "waypoints_b.csv": True}
