"""Small archives made from given bytes, for queries and tests over payloads."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib


def zip_of(files: dict[str, bytes], deflated: bool = False) -> bytes:
    at = io.BytesIO()
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED if deflated else zipfile.ZIP_STORED) as z:
        for name, data in files.items():
            z.writestr(name, data)
    return at.getvalue()


def rar4_of(files: dict[str, bytes], sizes: dict[str, int] | None = None, method: int = 0x30, crcs: dict[str, int] | None = None) -> bytes:
    """Old RAR: a header of each entry with a 16-bit checksum, then its data; ``sizes`` and ``crcs`` are those of unpacked data."""

    def block(kind: int, flags: int, body: bytes, data: bytes = b"") -> bytes:
        head = struct.pack("<BHH", kind, flags, 7 + len(body)) + body
        return struct.pack("<H", zlib.crc32(head) & 0xFFFF) + head + data

    out = [b"Rar!\x1a\x07\0", block(0x73, 0, bytes(6))]
    for name, data in files.items():
        raw, size, crc = name.encode(), (sizes or {}).get(name, len(data)), (crcs or {}).get(name, zlib.crc32(data))
        about = struct.pack("<IIBIIBBHI", len(data), size, 0, crc, 0, 20, method, len(raw), 0x20)
        out.append(block(0x74, 0x8000, about + raw, data))
    return b"".join([*out, block(0x7B, 0, b"")])


def _number(n: int) -> bytes:
    """Seven bits a byte, lowest first; all but the last have the top bit set."""
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def rar5_of(files: dict[str, bytes], sizes: dict[str, int] | None = None, method: int = 0, crcs: dict[str, int] | None = None) -> bytes:
    """New RAR: headers of numbers of any length with a 32-bit checksum."""

    def block(*fields: int | bytes) -> bytes:
        body = b"".join(_number(f) if isinstance(f, int) else f for f in fields)
        sized = _number(len(body)) + body
        return struct.pack("<I", zlib.crc32(sized)) + sized

    out = [b"Rar!\x1a\x07\x01\0", block(1, 0, 0)]
    for name, data in files.items():
        raw, size, crc = name.encode(), (sizes or {}).get(name, len(data)), (crcs or {}).get(name, zlib.crc32(data))
        out.append(block(2, 2, len(data), 4, size, 0, struct.pack("<I", crc), method << 7, 0, len(raw), raw) + data)
    return b"".join([*out, block(5, 0, 0)])
