"""Archives and subtitle files: kinds, entries, the first subtitle, and its text."""

from __future__ import annotations

import codecs
import functools
import io
import itertools
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_srt_text, looks_like_srt
from ..profile import DEFAULT, SiteProfile

# --- Text ---------------------------------------------------------------------------------------------------------

#: Legacy encodings in order of preference: the name to report and Python's codec.
LEGACY = (
    ("gb18030", "gb18030"), ("big5", "big5hkscs"), ("shift_jis", "cp932"),
    ("euc-jp", "euc_jp"), ("euc-kr", "cp949"), ("windows-1252", "cp1252"),
)
def _as_web(e: UnicodeError) -> tuple[str, int]:
    """What web decoders put for bytes that Python's codecs refuse: C1 controls, the euro sign, else U+FFFD."""
    if not isinstance(e, UnicodeDecodeError):
        raise e
    byte = e.object[e.start]
    if e.encoding in ("charmap", "cp1252"):
        return chr(byte), e.start + 1
    if e.encoding == "gb18030" and byte == 0x80:
        return "€", e.start + 1
    return "�", max(e.start + 1, min(e.end, e.start + 1))


codecs.register_error("cuesmith-web", _as_web)


def _score(text: str) -> int:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    count = lambda mask: int(np.count_nonzero(mask))
    controls = (c < 32) & (c != 9) & (c != 10) & (c != 13)
    return 20 * count((c >= 0x3400) & (c <= 0x9FFF)) - 10 * count(c == 0xFFFD) - 5 * count(controls)


def _most_wide(data: bytes) -> int:
    """The most characters of two bytes or more that any encoding can find: each begins with a byte over 127 and takes the next one."""
    high = np.frombuffer(data, np.uint8) > 127
    edges = np.flatnonzero(np.diff(high, prepend=False, append=False))
    return int(((edges[1::2] - edges[::2] + 1) // 2).sum())


def _unmarked_utf16(data: bytes) -> bool:
    """Little-endian UTF-16 by its look: many ASCII letters with a zero byte, no controls 0 to 2 among the first 64 units."""
    if len(data) < 16 or len(data) % 2:
        return False
    units = np.frombuffer(data[:512], "<u2")
    return np.count_nonzero((units >= 0x20) & (units < 0x7F)) > 32 and not (units[:64] <= 2).any()


def decode_legacy(data: bytes) -> tuple[str, str]:
    """Text and encoding of bytes that built-in functions leave: UTF-16 by its mark or its look, else the best-scored legacy one."""
    if data[:2] == b"\xff\xfe":
        return data[2:].decode("utf-16-le", "replace"), "utf-16le"
    if data[:2] == b"\xfe\xff":
        return data[2:].decode("utf-16-be", "replace"), "utf-16be"
    if _unmarked_utf16(data):
        return data.decode("utf-16-le", "replace"), "utf-16le"
    best: tuple[int, str, str] | None = None
    most = 20 * _most_wide(data)
    for name, codec in LEGACY:
        # No encoding's score exceeds the most, and that of one-byte letters isn't positive: a later one must be better.
        if best is not None and best[0] >= (0 if codec == "cp1252" else most):
            continue
        text = data.decode(codec, "cuesmith-web")
        score = _score(text)
        if best is None or score > best[0]:
            best = score, text, name
    return best[1], best[2]


@functools.cache
def _legacy():
    @F.pandas_udf("struct<text: string, encoding: string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for datas in parts:
            found = [(None, None) if d is None else decode_legacy(bytes(d)) for d in datas]
            yield pd.DataFrame(found, columns=["text", "encoding"])

    return run


def looks_like_utf16(data: Column) -> Column:
    """Whether bytes without a mark are little-endian UTF-16 by their look, which comes before UTF-8: zero bytes are valid there."""
    head = F.hex(F.substring(data, 1, 512))
    units = F.regexp_replace(head, "(.{4})", "$1 ")
    even = (F.octet_length(data) >= 16) & (F.octet_length(data) % 2 == 0)
    letters = F.regexp_count(units, F.lit("(?:[2-6][0-9A-F]|7[0-9A-E])00 ")) > 32
    low = F.substring(units, 1, 5 * 64).rlike("(?:^| )0[0-2]00 ")
    # Bytes without a zero among them, as most are, aren't looked at further.
    return F.coalesce(F.when(even & F.contains(head, F.lit("00")), letters & ~low), F.lit(False))


def decode_bytes(df: DataFrame, column: str = "body") -> DataFrame:
    """df with ``text`` and ``encoding``: UTF-8 by built-in functions, all else by a helper that only sees the rest.

    A mark decides first, then the look of UTF-16, then whether the bytes are UTF-8. Null bytes have neither text nor
    encoding. Malformed bytes become U+FFFD; nothing fails.
    """
    plain, text = _built_in(F.col(column))
    out = df.withColumn("__plain", plain)
    out = out.withColumn("__legacy", _legacy()(F.when(~F.col("__plain"), F.col(column))))
    return out.withColumns(
        {
            "text": F.when(F.col("__plain"), text).otherwise(F.col("__legacy.text")),
            "encoding": F.when(F.col("__plain"), "utf-8").otherwise(F.col("__legacy.encoding")),
        }
    ).drop("__legacy", "__plain")


def _built_in(data: Column) -> tuple[Column, Column]:
    """Whether bytes are UTF-8, by a mark or because they are valid and don't look like UTF-16, and their text if so."""
    head, as_text = F.hex(F.substring(data, 1, 3)), data.cast("string")
    marked, wide = head == "EFBBBF", F.substring(head, 1, 4).isin("FFFE", "FEFF")
    plain = ~marked & ~wide & F.is_valid_utf8(as_text) & ~looks_like_utf16(data)
    tail = F.substring(data, F.lit(4), F.octet_length(data)).cast("string")
    return marked | plain, F.when(marked, F.make_valid_utf8(tail)).otherwise(as_text)


# --- Kinds --------------------------------------------------------------------------------------------------------


def sniff_payload(content: Column, text: Column, profile: SiteProfile = DEFAULT) -> Column:
    """zip, rar4, rar5, srt (a plain subtitle, by its decoded text) or unsupported."""
    head = F.hex(F.substring(content, 1, 8))
    plain = (F.octet_length(content) <= profile.max_srt_bytes) & looks_like_srt(text)
    return (
        F.when(head.startswith("504B0304") | head.startswith("504B0506"), "zip")
        .when(head.startswith("526172211A070100"), "rar5")
        .when(head.startswith("526172211A0700"), "rar4")
        .when(F.coalesce(plain, F.lit(False)), "srt")
        .otherwise("unsupported")
    )


# --- Entries ------------------------------------------------------------------------------------------------------

ENTRY = (
    "ord int, name string, is_dir boolean, encrypted boolean, method int, packed_size long, size long, crc32 long, "
    "data_offset long, solid boolean, split boolean, format string"
)
_COLUMNS = [c.split()[0] for c in ENTRY.split(", ")]
_NUMBERS = [c.split()[0] for c in ENTRY.split(", ") if c.split()[1] in ("int", "long")]


class _Opened(io.RawIOBase):
    """What is sliced like bytes, as a file for zipfile, which reads a ZIP's tail and central directory."""

    def __init__(self, data: bytes) -> None:
        self.data, self.pos = data, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.pos

    def seek(self, to: int, whence: int = 0) -> int:
        self.pos = max(0, to + (0, self.pos, len(self.data))[whence])
        return self.pos

    def read(self, n: int = -1) -> bytes:
        out = self.data[self.pos :] if n is None or n < 0 else self.data[self.pos : self.pos + n]
        self.pos += len(out)
        return out


def _zip_start(data: bytes, header: int) -> int:
    """Where an entry's data begin, by its local header; -1 if there is none."""
    head = data[header : header + 30]
    return header + 30 + sum(struct.unpack("<HH", head[26:30])) if len(head) == 30 and head[:4] == b"PK\x03\x04" else -1


def _zip_entries(data: bytes, ranged: bool) -> Iterator[tuple]:
    for i, z in enumerate(zipfile.ZipFile(_Opened(data) if ranged else io.BytesIO(data)).infolist()):
        name = z.orig_filename
        if not z.flag_bits & 0x800:
            name = name.encode("cp437", "replace").decode("gb18030", "replace")
        start = None if ranged else _zip_start(data, z.header_offset)
        yield i, name, name.endswith("/"), bool(z.flag_bits & 1), z.compress_type, z.compress_size, z.file_size, z.CRC, start, False, False, "zip", z.header_offset


def _rar_name(raw: bytes, utf8: bool) -> str:
    try:
        name = raw.decode("utf-8")
    except UnicodeDecodeError:
        name = raw.decode("utf-8" if utf8 else "gb18030", "replace")
    return name.replace("\\", "/")


def _rar4_wide_name(raw: bytes) -> str:
    """A name kept as a short one and a delta to 16-bit characters: pairs of bits say how each is made."""
    short, _, code = raw.partition(b"\0")
    if not code:
        return _rar_name(short, False)
    high, out, pos, flags, left = code[0] << 8, [], 1, 0, 0
    while pos < len(code):
        if not left:
            flags, left, pos = code[pos], 4, pos + 1
            continue
        kind, flags, left = flags >> 6, flags << 2 & 0xFF, left - 1
        if kind == 0:
            out.append(code[pos])
        elif kind == 1:
            out.append(high | code[pos])
        elif kind == 2 and pos + 1 < len(code):
            out.append(code[pos] | code[pos + 1] << 8)
            pos += 1
        elif kind == 3:
            n = (code[pos] & 0x7F) + 2
            if code[pos] & 0x80 and pos + 1 < len(code):
                pos += 1
                out += [high | (c + code[pos] & 0xFF) for c in short[len(out) : len(out) + n]]
            else:
                out += short[len(out) : len(out) + n]
        pos += 1
    return struct.pack(f"<{len(out)}H", *out).decode("utf-16-le", "replace").replace("\\", "/")


def _rar4_entries(data: bytes, ranged: bool) -> Iterator[tuple]:
    pos, ord_ = 7, 0
    while pos + 7 <= len(data):
        kind, flags, size = _at("<BHH", data, pos + 2)
        after = pos + size
        if size < 7 or kind == 0x7B:
            return
        added = _at("<I", data, pos + 7)[0] if (flags & 0x8000 or kind in (0x74, 0x7A)) and pos + 11 <= len(data) else 0
        if kind == 0x74:
            packed, full, _, crc, _, version, method, n, attributes = _at("<IIBIIBBHI", data, pos + 7)
            at = pos + 32
            if flags & 0x100:
                more = _at("<II", data, at)
                packed, full, at = packed | more[0] << 32, full | more[1] << 32, at + 8
            raw = data[at : at + n]
            name = _rar4_wide_name(raw) if flags & 0x200 else _rar_name(raw, False)
            folder = flags & 0xE0 == 0xE0 or version < 20 and bool(attributes & 0x10)
            yield ord_, name, folder, bool(flags & 4), method - 0x30, packed, full, crc, after, bool(flags & 0x10), bool(flags & 3), "rar4", pos
            ord_, added = ord_ + 1, packed
        pos = after + added


def _at(form: str, data: bytes, pos: int) -> tuple:
    return struct.unpack(form, data[pos : pos + struct.calcsize(form)])


class _Vints:
    """Reads numbers of seven bits a byte, lowest first."""

    def __init__(self, data: bytes, pos: int) -> None:
        self.data, self.pos = data, pos

    def __call__(self) -> int:
        value = shift = 0
        while True:
            b = self.data[self.pos]
            self.pos += 1
            value |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80 or shift > 63:
                return value


def _rar5_entries(data: bytes, ranged: bool) -> Iterator[tuple]:
    pos, ord_ = 8, 0
    while pos + 5 <= len(data):
        read = _Vints(data, pos + 4)
        size = read()
        end = read.pos + size
        if not size or end > len(data):
            return
        kind, flags = read(), read()
        if flags & 1:
            read()
        packed = read() if flags & 2 else 0
        if kind == 5:
            return
        if kind == 2:
            about, full, _ = read(), read(), read()
            read.pos += 4 if about & 2 else 0
            crc = _at("<I", data, read.pos)[0] if about & 4 else 0
            read.pos += 4 if about & 4 else 0
            how, _, n = read(), read(), read()
            name = _rar_name(data[read.pos : min(read.pos + n, end)], True)
            yield ord_, name, bool(about & 1), False, how >> 7 & 7, packed, full, crc, end, bool(how & 0x40), bool(flags & 0x18), "rar5", pos
            ord_ += 1
        pos = end + packed


_LISTERS = {"zip": _zip_entries, "rar4": _rar4_entries, "rar5": _rar5_entries}


def _kind(data: bytes) -> str | None:
    if data[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
        return "zip"
    return "rar5" if data[:8] == b"Rar!\x1a\x07\x01\0" else "rar4" if data[:7] == b"Rar!\x1a\x07\0" else None


def listed(data: bytes, most: int | None = None, ranged: bool = False) -> tuple[list[dict] | None, str | None]:
    """The entries of an archive, at most so many, or why there are none; neither for what is no archive.

    With ``ranged``, data may be anything that is sliced like bytes; local headers of a ZIP aren't read, so its
    entries have no data_offset, and header_offset leads to it.
    """
    if not (kind := _kind(data)):
        return None, None
    try:
        return [dict(zip((*_COLUMNS, "header_offset"), e, strict=True)) for e in itertools.islice(_LISTERS[kind](data, ranged), most)], None
    except Exception as e:  # whatever is wrong with an archive is the row's problem, not the job's
        return None, f"Invalid archive: {e}"


def _entries(content: bytes | None, most: int | None = None) -> tuple[list[dict] | None, str | None]:
    entries, problem = listed(bytes(content) if content is not None else b"", most)
    return [{c: e[c] for c in _COLUMNS} for e in entries] if entries is not None else None, problem


def list_entries(archives: DataFrame) -> DataFrame:
    """``archives(archive_id, content)`` -> a row for each entry, and one with only ``problem`` for an unreadable archive.

    No payload leaves the helper. Contents that are no archive give no rows.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for id_, content in zip(part["archive_id"], part["content"], strict=True):
                entries, problem = _entries(content)
                rows += [(id_, *e.values(), None) for e in entries or ()]
                if problem:
                    rows.append((id_, *[None] * len(_COLUMNS), problem))
            yield pd.DataFrame(rows, columns=["archive_id", *_COLUMNS, "problem"]).astype(object)

    return archives.select(F.col("archive_id").cast("string").alias("archive_id"), "content").mapInPandas(
        run, f"archive_id string, {ENTRY}, problem string"
    )


def guard_entry_count(entries: DataFrame, max_entries: int = DEFAULT.max_entries) -> DataFrame:
    """``archive_id, n_entries, problem``: archives with too many entries, of whatever kind, are refused."""
    return entries.groupBy("archive_id").agg(
        F.count("ord").alias("n_entries"),
        F.coalesce(F.first("problem", True), F.when(F.count("ord") > max_entries, "Archive contains too many entries")).alias("problem"),
    )


def is_safe_path(name: Column) -> Column:
    path = F.replace(name, F.lit("\\"), F.lit("/"))
    return F.coalesce(
        (name != "")
        & ~F.contains(name, F.lit("\0"))
        & ~path.startswith("/")
        & ~path.rlike(r"\A(?i:[a-z]):")
        & ~F.array_contains(F.split(path, "/"), ".."),
        F.lit(False),
    )


def _is_srt(e: Callable[[str], Column]) -> Column:
    """Of an entry's fields: a subtitle that may be taken. An encrypted ZIP entry may, and then fails; one of RAR is passed over."""
    hidden = e("encrypted") & (e("format") != "zip")
    return ~e("is_dir") & ~hidden & is_safe_path(e("name")) & F.endswith(F.lower(e("name")), F.lit(".srt"))


def srt_entries(entries: DataFrame) -> DataFrame:
    return entries.where(_is_srt(F.col))


def first_srt(entries: DataFrame) -> DataFrame:
    """The first subtitle of each archive in the order of names as a reader sorts them, then of entries."""
    order = W.partitionBy("archive_id").orderBy(F.collate("name", "UNICODE"), "ord")
    return srt_entries(entries).withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


Extractor = Callable[[bytes, dict], bytes]


def _extract(data: bytes, e: dict, most: int, rar: Extractor | None) -> bytes:
    if e["size"] > most:
        raise ValueError("SRT file is too large")
    if e["format"] == "zip":
        if e["encrypted"]:
            raise ValueError("Encrypted ZIP entries are not supported")
    start = _zip_start(data, e["header_offset"]) if e["data_offset"] is None else e["data_offset"]
    if start < 0:
        raise ValueError("Invalid ZIP local file header")
    raw = data[start : start + e["packed_size"]]
    if len(raw) < e["packed_size"]:
        raise ValueError("Archive ends within an entry")
    if e["format"] == "zip":
        if e["method"] == 0:
            out = raw
        elif e["method"] == 8:
            inflate = zlib.decompressobj(-15)
            out = inflate.decompress(raw, most + 1)
            if not inflate.eof and len(out) <= most:
                raise ValueError("Compressed data ends early")
        else:
            raise ValueError("compression method is not supported")
    else:
        if e["split"]:
            raise ValueError("entries over several volumes are not supported")
        if e["method"] == 0:
            out = raw[: e["size"]]
        elif rar:
            out = rar(bytes(data), e)
        else:
            raise ValueError("compressed RAR entries need an extractor")
        if e["crc32"] and zlib.crc32(out) != e["crc32"]:
            raise ValueError("RAR entry checksum mismatch")
    if len(out) > most:
        raise ValueError("SRT file is too large")
    if len(out) != e["size"]:
        raise ValueError("Entry does not have its declared size")
    return out


def taken(data: bytes, e: dict, most: int, rar: Extractor | None) -> tuple[bytes | None, str | None]:
    """An entry's bytes, or what is wrong with it; data is bytes or sliced like them."""
    try:
        return _extract(data, e, most, rar), None
    except Exception as x:  # as above; also whatever an extractor raises
        return None, str(x) or type(x).__name__


def extract_entry(archives: DataFrame, picks: DataFrame, profile: SiteProfile = DEFAULT, rar_extractor: Extractor | None = None) -> DataFrame:
    """The bytes of each picked entry: ``archive_id, name, data, problem``.

    Stored and deflated ZIP and stored RAR entries are read here, other RAR entries by ``rar_extractor(content, entry)``.
    Inflating stops one byte past the limit, whatever the entry declares.
    """
    fields = [c for c in _COLUMNS if c != "ord"]
    most = profile.max_srt_bytes

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for row in part.to_dict("records"):
                rows.append((row["archive_id"], row["name"], *taken(bytes(row["content"]), row, most, rar_extractor)))
            yield pd.DataFrame(rows, columns=["archive_id", "name", "data", "problem"])

    met = picks.select("archive_id", *fields).join(
        archives.select(F.col("archive_id").cast("string").alias("archive_id"), "content"), "archive_id"
    )
    return met.mapInPandas(run, "archive_id string, name string, data binary, problem string")


_ROW = f"struct<{ENTRY.replace(' ', ': ').replace(',: ', ', ')}>"


def _lister(most: int):
    """Of an archive its entries or its problem, of other bytes (which built-in functions can't decode) whether they are a subtitle."""

    @F.pandas_udf(f"struct<entries: array<{_ROW}>, problem: string, srt: boolean>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for contents in parts:
            rows = []
            for c in contents:
                entries, problem = _entries(c, most)
                other = c is not None and entries is None and problem is None
                rows.append((entries, problem, is_srt_text(decode_legacy(bytes(c))[0]) if other else False))
            yield pd.DataFrame(rows, columns=["entries", "problem", "srt"])

    return run.asNondeterministic()  # evaluated once, where it stands


def _taker(most: int, rar: Extractor | None):
    @F.pandas_udf("struct<data: binary, problem: string>")
    def run(parts: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        for contents, picks in parts:
            # Beside rows without an entry, pandas has made the numbers floats.
            whole = lambda e: e | {k: int(e[k]) for k in _NUMBERS}
            rows = [(None, None) if c is None else taken(bytes(c), whole(e), most, rar) for c, e in zip(contents, picks.to_dict("records"), strict=True)]
            yield pd.DataFrame(rows, columns=["data", "problem"])

    return run.asNondeterministic()


def extract_first_srt(archives: DataFrame, profile: SiteProfile = DEFAULT, rar_extractor: Extractor | None = None) -> DataFrame:
    """``archives(archive_id, content)`` -> ``archive_id, name, data, problem``, one row each.

    Payloads that look like subtitles are taken as they are, archives give their first subtitle. Listing, picking and
    extracting happen in the row, so no payload is shuffled; entries past the limit aren't listed.
    """
    head = F.hex(F.substring("content", 1, 8))
    packed = F.coalesce(
        head.startswith("504B0304") | head.startswith("504B0506") | head.startswith("526172211A0700") | head.startswith("526172211A070100"),
        F.lit(False),
    )
    keyed = archives.select(F.col("archive_id").cast("string").alias("archive_id"), "content", packed.alias("__packed"))
    # What is no archive is decoded only to see whether it is a subtitle, by the helper only where it isn't UTF-8.
    plain, text = _built_in(F.col("content"))
    kinds = keyed.withColumns({"__plain": ~F.col("__packed") & plain, "__small": F.octet_length("content") <= profile.max_srt_bytes})
    asked = F.when(F.col("__packed") | ~F.col("__plain") & F.col("__small"), F.col("content"))
    listed = kinds.withColumn("__l", _lister(profile.max_entries + 1)(asked))
    is_srt = F.when(F.col("__plain"), looks_like_srt(text)).otherwise(F.col("__l.srt"))
    listed = listed.withColumn("__srt", F.coalesce(~F.col("__packed") & F.col("__small") & is_srt, F.lit(False)))
    wanted = F.filter("__l.entries", lambda x: _is_srt(lambda c: x[c]))
    first = F.array_min(F.transform(wanted, lambda x: F.struct(F.collate(x["name"], "UNICODE").alias("name"), x["ord"].alias("ord"))))
    many = F.coalesce(F.size("__l.entries") > profile.max_entries, F.lit(False))
    why = F.coalesce(
        F.when(~F.col("__packed") & ~F.col("__srt"), "Unsupported archive format"),
        F.when(many, "Archive contains too many entries"),
        F.col("__l.problem"),
        F.when(F.col("__packed") & first.isNull(), "Archive does not contain an SRT file"),
    )
    picked = listed.withColumns({"__why": why, "__e": F.when(F.col("__packed") & ~many, F.get("__l.entries", first["ord"]))}).drop("__l")
    took = picked.withColumn(
        "__t", _taker(profile.max_srt_bytes, rar_extractor)(F.when(F.col("__why").isNull() & F.col("__packed"), F.col("content")), F.col("__e"))
    )
    return took.select(
        "archive_id",
        F.when(F.col("__srt"), "subtitle.srt").otherwise(F.col("__e.name")).alias("name"),
        F.when(F.col("__srt"), F.col("content")).otherwise(F.col("__t.data")).alias("data"),
        F.coalesce("__why", "__t.problem").alias("problem"),
    )
