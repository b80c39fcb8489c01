"""Archives, encodings, the cache and the sinks."""

from __future__ import annotations

import io
import random
import struct
import zipfile
import zlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cuesmith.operators import cache, payload
from cuesmith.profile import SiteProfile
from cuesmith.sources import io as sources

SITE = SiteProfile()
CUES = "\n\n".join(f"{i}\n0:0{i}:10.5 --> 0:0{i}:12.75\n第{i}句：雨还在下" for i in range(1, 4))


def archive(files: dict[str, bytes], deflated: bool = False) -> bytes:
    at = io.BytesIO()
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED if deflated else zipfile.ZIP_STORED) as z:
        for name, data in files.items():
            z.writestr(name, data)
    return at.getvalue()


def central(data: bytes, at: int, value: bytes) -> bytes:
    """The archive with a field of its first central header overwritten."""
    start = data.index(b"PK\x01\x02") + at
    return data[:start] + value + data[start + len(value) :]


def old_rar(name: bytes, data: bytes, *, method: int = 0x30, crc: int | None = None, flags: int = 0x8000) -> bytes:
    def block(kind: int, flags: int, body: bytes = b"", tail: bytes = b"") -> bytes:
        head = struct.pack("<BHH", kind, flags, 7 + len(body)) + body
        return struct.pack("<H", zlib.crc32(head) & 0xFFFF) + head + tail

    sum_ = zlib.crc32(data) if crc is None else crc
    about = struct.pack("<IIBIIBBHI", len(data), len(data), 0, sum_, 0, 20, method, len(name), 0x20)
    return b"Rar!\x1a\x07\0" + block(0x73, 0, bytes(6)) + block(0x74, flags, about + name, data) + block(0x7B, 0)


def new_rar(name: bytes, data: bytes) -> bytes:
    def number(n: int) -> bytes:
        low = n & 0x7F
        return bytes([low | 0x80]) + number(n >> 7) if n > 0x7F else bytes([low])

    def block(*fields: int | bytes) -> bytes:
        body = b"".join(number(f) if isinstance(f, int) else f for f in fields)
        sized = number(len(body)) + body
        return struct.pack("<I", zlib.crc32(sized)) + sized

    file = block(2, 2, len(data), 4, len(data), 0, struct.pack("<I", zlib.crc32(data)), 0, 0, len(name), name)
    return b"Rar!\x1a\x07\x01\0" + block(1, 0, 0) + file + data + block(5, 0, 0)


def taken(spark, content: bytes | None, rar=None, **limits) -> tuple:
    rows = spark.createDataFrame([("a", content)], "archive_id string, content binary")
    r = payload.extract_first_srt(rows, SiteProfile(**limits), rar).first()
    return r["name"], r["data"] if r["data"] is None else bytes(r["data"]), r["problem"]


@pytest.mark.parametrize("deflated", [False, True])
def test_first_safe_subtitle_of_a_zip(spark, deflated):
    files = {"disc2/late.srt": b"two", "disc1/early.srt": b"one", "/root.srt": b"abs", "disc0/../up.srt": b"up", "disc0.srt/": b"", "disc0.sub": b"sub", "c:\\a.srt": b"drive"}
    assert taken(spark, archive(files, deflated)) == ("disc1/early.srt", b"one", None)


def test_names_sort_as_readers_do(spark):
    assert taken(spark, archive({"Ocean.srt": b"O", "air.srt": b"a", "海.srt": b"h"}))[0] == "air.srt"
    assert taken(spark, archive({"Ocean.SRT": b"O", "海.srt": b"h"}))[0] == "Ocean.SRT"


def test_names_without_the_unicode_flag(spark):
    raw = "雨夜.srt".encode("gb18030")
    data = archive({"x" * (len(raw) - 4) + ".srt": b"rain"}).replace(b"x" * (len(raw) - 4) + b".srt", raw)
    assert taken(spark, data) == ("雨夜.srt", b"rain", None)


def test_rar_archives(spark):
    assert taken(spark, old_rar(b"rain.srt", b"drops")) == ("rain.srt", b"drops", None)
    assert taken(spark, new_rar("s1/雨.srt".encode(), b"drizzle")) == ("s1/雨.srt", b"drizzle", None)
    assert taken(spark, old_rar(b"s1\\rain.srt", b"drops", crc=77))[2] == "RAR entry checksum mismatch"
    assert "extractor" in taken(spark, old_rar(b"rain.srt", b"drops", method=0x35))[2]
    assert taken(spark, old_rar(b"rain.srt", b"drops", flags=0x8004))[2] == "Archive does not contain an SRT file"


def test_rar_plug_in_and_its_failures(spark):
    packed = old_rar(b"rain.srt", b"drops", method=0x35)
    assert taken(spark, packed, lambda content, entry: b"drops") == ("rain.srt", b"drops", None)

    def fails(content, entry):
        raise RuntimeError("no dictionary")

    assert taken(spark, packed, fails) == ("rain.srt", None, "no dictionary")


def test_limits(spark):
    two = archive({"one.srt": b"rainy", "two.nfo": b""})
    assert taken(spark, two, max_entries=1)[2] == "Archive contains too many entries"
    assert taken(spark, two, max_entries=2)[1] == b"rainy"
    assert taken(spark, two, max_srt_bytes=4)[2] == "SRT file is too large"
    bomb = central(archive({"one.srt": b"-" * 90_000}, True), 24, struct.pack("<I", 9))
    assert taken(spark, bomb, max_srt_bytes=60)[2] == "SRT file is too large"
    assert taken(spark, bomb)[2] == "Entry does not have its declared size"


def test_broken_archives_are_rows_with_a_problem(spark):
    good = archive({"one.srt": CUES.encode() * 20, "two.srt": b"next"}, True)
    size = struct.unpack_from("<I", good, good.index(b"PK\x01\x02") + 20)[0]
    assert taken(spark, central(good, 20, struct.pack("<I", size // 2))) == ("one.srt", None, "Compressed data ends early")
    assert taken(spark, b"PK\x03\x04" + good[4:].replace(b"PK\x03\x04", b"PK\x03\x05", 1))[1] is not None  # the second entry's
    assert taken(spark, central(good, 42, struct.pack("<I", 5)))[2] == "Invalid ZIP local file header"
    assert taken(spark, central(good, 8, b"\x01\x00")) == ("one.srt", None, "Encrypted ZIP entries are not supported")
    assert taken(spark, central(good, 10, b"\x0c\x00"))[2] == "compression method is not supported"
    assert taken(spark, archive({}))[2] == "Archive does not contain an SRT file"
    assert taken(spark, good[: len(good) // 2])[2].startswith("Invalid archive")
    assert taken(spark, b"<html>")[2] == taken(spark, None)[2] == taken(spark, b"")[2] == "Unsupported archive format"
    assert taken(spark, CUES.encode()) == ("subtitle.srt", CUES.encode(), None)


def test_steps_over_tables_equal_the_row(spark):
    contents = [archive({"b.srt": b"b", "a.srt": b"a"}), archive({"n.txt": b""}), old_rar(b"r.srt", b"r"), b"PK\x03\x04??"]
    df = spark.createDataFrame([(str(i), c) for i, c in enumerate(contents)], "archive_id string, content binary")
    entries = payload.list_entries(df)
    got = {r["archive_id"]: bytes(r["data"]) for r in payload.extract_entry(df, payload.first_srt(entries.where("problem is null"))).collect()}
    assert got == {r["archive_id"]: bytes(r["data"]) for r in payload.extract_first_srt(df).where("data is not null").collect()} == {"0": b"a", "2": b"r"}
    guard = {r["archive_id"]: (r["n_entries"], r["problem"] is None) for r in payload.guard_entry_count(entries, 1).collect()}
    assert guard == {"0": (2, False), "1": (1, True), "2": (1, True), "3": (0, False)}


def test_archives_beside_other_payloads(spark):
    rows = [("z", archive({"a.srt": b"a"}, True)), ("p", CUES.encode()), ("x", b"?"), ("n", None), ("e", archive({}))]
    df = spark.createDataFrame(rows, "archive_id string, content binary").coalesce(1)
    got = {r["archive_id"]: (r["name"], r["problem"] is None) for r in payload.extract_first_srt(df).collect()}
    assert got == {"z": ("a.srt", True), "p": ("subtitle.srt", True), "x": (None, False), "n": (None, False), "e": (None, False)}


def decoded(spark, data: bytes) -> tuple[str, str]:
    r = payload.decode_bytes(spark.createDataFrame([(data,)], "body binary")).first()
    return r["text"], r["encoding"]


@pytest.mark.parametrize(
    ("data", "encoding"),
    [
        (CUES.encode(), "utf-8"), (b"\xef\xbb\xbf" + CUES.encode(), "utf-8"), (CUES.encode("gb18030"), "gb18030"),
        (b"\xff\xfe" + CUES.encode("utf-16-le"), "utf-16le"), (b"\xfe\xff" + CUES.encode("utf-16-be"), "utf-16be"),
        (CUES.encode("utf-16-le"), "utf-16le"),
    ],
)
def test_decoding(spark, data, encoding):
    assert decoded(spark, data) == (CUES, encoding)


def test_unmarked_utf16_is_seen_before_utf8(spark):
    plain = "A plain line of English, long enough to be seen as such."
    assert decoded(spark, plain.encode("utf-16-le")) == (plain, "utf-16le")  # its zero bytes are valid UTF-8
    assert decoded(spark, plain.encode("utf-16-le") + b"x")[1] == "utf-8"  # an odd length
    assert decoded(spark, "too short to tell".encode("utf-16-le"))[1] == "utf-8"
    assert decoded(spark, ("\x01" + plain).encode("utf-16-le"))[1] == "utf-8"
    assert decoded(spark, plain.encode("utf-16-be"))[1] == "utf-8"  # the other order isn't guessed


def _best(data: bytes) -> tuple[str, str]:
    """The rule, one character after the other."""
    scored = []
    for i, (name, codec) in enumerate(payload.LEGACY):
        text = data.decode(codec, "cuesmith-web")
        score = sum(20 if "\u3400" <= c <= "\u9fff" else -10 if c == "\ufffd" else -5 if c < " " and c not in "\t\n\r" else 0 for c in text)
        scored.append((-score, i, text, name))
    return min(scored)[2:]


@pytest.mark.parametrize("codec", ["gb18030", "big5", "shift_jis", "euc_jp", "euc_kr", "cp1252"])
def test_legacy_encodings_follow_the_score(spark, codec):
    texts = {"big5": "這裡的雨還在下", "shift_jis": "雨はまだ降っている。", "euc_jp": "雨はまだ降っている。", "euc_kr": "비가 아직 내린다", "cp1252": "Il pleut encore, là-bas"}
    data = texts.get(codec, CUES).encode(codec)
    assert decoded(spark, data) == _best(data)
    assert decoded(spark, data + b"\x80\xff")[0] == _best(data + b"\x80\xff")[0]


def test_malformed_bytes_never_fail(spark):
    random.seed(3)
    rows = [(None,), (b"",), (b"\xff\xfe\x00",), (b"\xef\xbb\xbf\xff",), (b"\x80\x81",), *((random.randbytes(random.randrange(200)),) for _ in range(200))]
    got = payload.decode_bytes(spark.createDataFrame(rows, "body binary")).collect()
    assert got[0]["text"] is None and got[1]["text"] == "" and got[3]["text"] == "�"
    assert all(r["text"] is not None for r in got[1:])


def _fold(rows: list[tuple], ttl: int) -> dict:
    out: dict = {}
    state: dict = {}
    for rid, id_, t, latency, ok in sorted(rows, key=lambda r: (r[2], r[0])):
        busy, cached = state.get(id_, (None, None))
        if busy is not None and t < busy:
            out[rid] = "coalesced"
        elif cached is not None and cached <= t and t - cached <= ttl:
            out[rid] = "hit"
        else:
            out[rid] = "miss"
            state[id_] = (t + latency, t + latency if ok else None)
    return out


def test_replay_equals_a_fold(spark):
    random.seed(4)
    rows = [(i, random.choice("aaaab"), random.randrange(500) * 1000, random.choice([0, 3000]), random.random() < 0.8) for i in range(400)]
    at = datetime(2024, 1, 1)
    df = spark.createDataFrame([(r, i, at + timedelta(milliseconds=t), lat, ok) for r, i, t, lat, ok in rows], "request_id long, id string, ts timestamp, latency_ms long, ok boolean")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # state must outlive a batch
    try:
        got = {r["request_id"]: r["outcome"] for r in cache.replay_cache(df, 20_000).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == _fold(rows, 20_000) and set(got.values()) == {"hit", "miss", "coalesced"}


def test_split_cache(spark):
    now = datetime(2024, 1, 2)
    age = lambda s: now - timedelta(seconds=s)
    written = spark.createDataFrame([("1", age(60), 5), ("2", age(61), 5), ("3", age(1), 33 << 20), ("4", None, 5)], "id string, cached_at timestamp, n_bytes long")
    ids = spark.createDataFrame([(str(i),) for i in range(6)], "id string")
    hit, miss = cache.split_cache(ids, written, F.lit(now), 60_000)
    assert [r["id"] for r in hit.collect()] == ["1"] and {r["id"] for r in miss.collect()} == set("02345")
    assert cache.effective_ttl(-1) == cache.effective_ttl("x") == cache.effective_ttl(float("nan")) == SITE.ttl_ms


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1234", "x" * 100), ("12", None), ("99", "y")], "id string, text string")
    sources.write_subtitles(df, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert {(r["id"], r["n_bytes"]) for r in back.collect()} == {("1234", 100), ("99", 1)}
    large = sources.within_limit(spark.createDataFrame([("1", "雨" * 4), ("2", "雨" * 3)], "id string, text string"), SiteProfile(max_srt_bytes=9))
    assert {r["id"]: r["error"] and r["error"]["code"] for r in large.collect()} == {"1": "SRT_TOO_LARGE", "2": None}
    kv = {r["key"]: r for r in sources.to_kv(df, 500).collect()}
    assert "\n" not in kv["1234"]["value"] and kv["99"]["expires_s"] == 1 and "12" not in kv
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a").write_bytes(b"12345")
    (tmp_path / "f" / "b").write_bytes(b"123456")
    assert [bytes(r["content"]) for r in sources.read_archives(spark, str(tmp_path / "f"), 5).collect()] == [b"12345"]
    hits = spark.createDataFrame([("7", "Rain", None, "Subrip(srt)", "", None, "https://subs.example/sub/7/x")], "id string, title string, version string, format string, language string, date string, detail_url string")
    sources.write_hits(hits, str(tmp_path / "hits"))
    assert spark.read.json(str(tmp_path / "hits")).select(hits.columns).collect() == hits.collect()


def test_encodings_that_cannot_win_are_not_tried():
    """The bound on a score holds for each encoding, and the choice is that of a trial of all."""
    texts = ["一乙丁 abc", "日本語アｱ", "é à ü ", "字" * 9 + "，", "a", ""]
    for data in [t.encode(c, "ignore") for t in texts for c in ("gb18030", "big5hkscs", "cp932", "euc_jp", "cp949", "cp1252")] + [b"\xff\x80a\x81", b"\x80" * 7]:
        tried = [(payload._score(t := data.decode(codec, "cuesmith-web")), t, name) for name, codec in payload.LEGACY]
        assert all(s <= 20 * payload._most_wide(data) for s, _, _ in tried)
        assert payload.decode_legacy(data) == max(tried, key=lambda x: x[0])[1:]
