"""Archives in a folder, listed and read by ranges."""

from __future__ import annotations

import io
import zipfile

import pytest

from cuesmith.jobs import catalog_files
from cuesmith.jobs.builders import rar4_of, rar5_of
from cuesmith.operators.payload import extract_first_srt, list_entries
from cuesmith.profile import SiteProfile
from cuesmith.sources import archives


def zipped(**files: str) -> bytes:
    at = io.BytesIO()
    with zipfile.ZipFile(at, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/").replace("_srt", ".srt"), text, zipfile.ZIP_DEFLATED if len(text) > 20 else zipfile.ZIP_STORED)
    return at.getvalue()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("archives")
    files = {
        "one.zip": zipped(b_srt="second", a_srt="first " * 50, readme="x" * 200_000),
        "none.zip": zipped(readme="nothing"),
        "deep/two.rar": rar4_of({"first.srt": b"R" * 30_000}),
        "deep/three.rar": rar5_of({"x/first.srt": b"S" * 30_000}),
        "cut.zip": zipped(a_srt="text " * 40)[:-30],
        "plain.txt": b"no archive",
        "empty.zip": b"",
        "many.zip": zipped(**{f"n{i}_srt": "" for i in range(12)}),
        "large.zip": zipped(a_srt="x") + b"\0" * 400_000,
    }
    for name, data in files.items():
        (at / name).parent.mkdir(exist_ok=True)
        (at / name).write_bytes(data)
    return at


PROFILE = SiteProfile(max_entries=10, max_archive_bytes=300_000)


def name(path: str) -> str:
    return path.rsplit("/", 1)[1]


def test_listing_equals_that_of_whole_contents(spark, folder):
    rows = archives.list_archives(spark, f"file://{folder}", PROFILE).collect()
    whole = [(f"file://{p}", p.read_bytes()) for p in folder.rglob("*") if p.is_file() and p.stat().st_size <= 300_000]
    want = list_entries(spark.createDataFrame(whole, "archive_id string, content binary")).where("problem is null").collect()
    cells = lambda r: (name(r["archive_id"]), r["ord"], r["name"], r["is_dir"], r["method"], r["packed_size"], r["size"], r["crc32"], r["format"])
    assert sorted(map(cells, (r for r in rows if r["problem"] is None))) == sorted(c for c in map(cells, want) if c[0] != "many.zip")
    problems = {name(r["archive_id"]): r["problem"] for r in rows if r["problem"]}
    assert problems.pop("cut.zip").startswith("Invalid archive")
    assert problems == {"plain.txt": "Unsupported archive format", "empty.zip": "Unsupported archive format", "many.zip": "Archive contains too many entries"}
    assert "large.zip" not in {name(r["archive_id"]) for r in rows}
    assert {name(r["archive_id"]): r["n_entries"] for r in rows if r["n_entries"]} == {"one.zip": 3, "none.zip": 1, "two.rar": 1, "three.rar": 1}


def test_only_headers_are_read(spark, folder):
    rows = archives.list_archives(spark, f"file://{folder}", PROFILE).where("length > 25000").collect()
    assert {name(r["archive_id"]) for r in rows} == {"two.rar", "three.rar"}
    assert all(0 < r["bytes_read"] * 10 < r["length"] for r in rows)


def test_filters_reach_the_reader(spark, folder, capsys):
    df = archives.list_archives(spark, f"file://{folder}", PROFILE, files_per_partition=1)
    slim = df.where("lower_name like '%.srt' and length < 20000 and size in (300, 6)")
    slim.explain("formatted")
    plan = capsys.readouterr().out
    assert "Filter" not in plan.split("BatchScan")[0], plan
    assert sorted((name(r["archive_id"]), r["name"]) for r in slim.collect()) == [("one.zip", "a.srt"), ("one.zip", "b.srt")]
    assert df.where("problem is not null and lower_name is null").count() == 4
    assert sorted(r["name"] for r in df.where("upper(name) = 'README' and not is_dir").collect()) == ["readme", "readme"]


def test_first_subtitles_equal_those_of_whole_contents(spark, folder):
    got = {name(r["archive_id"]): r for r in archives.first_subtitles(spark, f"file://{folder}", PROFILE).collect()}
    whole = [(f"file://{p}", p.read_bytes()) for p in folder.rglob("*") if p.is_file() and p.stat().st_size <= 300_000]
    want = {name(r["archive_id"]): r for r in extract_first_srt(spark.createDataFrame(whole, "archive_id string, content binary"), PROFILE).collect()}
    assert got.keys() == want.keys()
    for k, r in want.items():
        assert (got[k]["data"], got[k]["problem"] is None) == (r["data"], r["problem"] is None), k
    assert got["one.zip"]["bytes_read"] * 20 > got["one.zip"]["length"] or got["one.zip"]["bytes_read"] < 2500


def test_empty_folder_and_bad_offsets(spark, tmp_path):
    assert archives.list_archives(spark, f"file://{tmp_path}").count() == 0
    data = bytearray(zipped(a_srt="text"))
    data[0] = 0  # no local header where the directory says
    (tmp_path / "a.zip").write_bytes(data)
    assert archives.first_subtitles(spark, f"file://{tmp_path}").first()["problem"] == "Unsupported archive format"
    good = zipped(a_srt="text", b_srt="more")
    at = good.index(b"PK\x03\x04", 10)
    (tmp_path / "a.zip").write_bytes(good[:at] + b"xx" + good[at + 2 :])
    rows = archives.read_entries(archives.list_archives(spark, f"file://{tmp_path}")).collect()
    assert {r["name"]: (r["data"], r["problem"]) for r in rows} == {"a.srt": (bytearray(b"text"), None), "b.srt": (None, "Invalid ZIP local file header")}


def test_little_is_read_of_archives_of_any_size(spark, tmp_path):
    """Of an archive of some 70 KB the directory alone is a twentieth."""
    rows = [(50 * n + i, "x" * size) for n, size in enumerate((10, 1180, 1250, 1320, 3000)) for i in range(50)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog_files.ranged_listing(spark, str(tmp_path)).collect()
    assert {r["archive"] for r in got} == {0, 1, 2, 4} and all(r["few"] for r in got)
