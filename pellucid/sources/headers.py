"""The size that a picture's header states, found by reading a few ranges of the file."""

from __future__ import annotations

from collections.abc import Callable, Iterator

#: read(at, n): up to n bytes of the file from at on.
Read = Callable[[int, int], bytes]
Size = tuple[int, int] | None

#: Directories of a TIFF file, and boxes of a file, that are looked at.
MOST = 4096
#: TIFF's tags of width and height, and bytes of its number types.
WIDTH, HEIGHT = 256, 257
NUMBERS = {1: 1, 3: 2, 4: 4, 16: 8}
#: Brands of pictures in boxes.
BRANDS = (b"heic", b"heix", b"hevc", b"hevx", b"heim", b"heis", b"mif1", b"msf1", b"avif", b"avis")


def _little(raw: bytes) -> int:
    return int.from_bytes(raw, "little")


def _big(raw: bytes) -> int:
    return int.from_bytes(raw, "big")


def _jpeg(read: Read, size: int) -> Size:
    at = 2
    while at + 9 < size:
        marker = read(at, 9)
        if len(marker) < 9 or marker[0] != 0xFF:
            return None
        if 0xC0 <= marker[1] <= 0xCF and marker[1] not in (0xC4, 0xC8, 0xCC):
            return _big(marker[7:9]), _big(marker[5:7])
        at += 2 + _big(marker[2:4])
    return None


def _webp(head: bytes) -> Size:
    kind = head[12:16]
    if kind == b"VP8X" and len(head) >= 30:
        return 1 + _little(head[24:27]), 1 + _little(head[27:30])
    if kind == b"VP8 " and len(head) >= 30 and head[23:26] == b"\x9d\x01\x2a":
        return _little(head[26:28]) & 0x3FFF, _little(head[28:30]) & 0x3FFF  # the upper two bits scale
    if kind == b"VP8L" and len(head) >= 25 and head[20] == 0x2F:
        bits = _little(head[21:25])
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    return None


def _tiff(head: bytes, read: Read) -> Size:
    """The first directory that has both sizes; directories are a chain, in one of two byte orders, with offsets of 4 bytes or 8."""
    number = _little if head[:2] == b"II" else _big
    wide = number(head[2:4]) == 43
    if wide and number(head[4:6]) != 8:
        return None
    width = 8 if wide else 4
    at, seen = number(head[8:16] if wide else head[4:8]), set()
    while at and at not in seen and len(seen) < MOST:
        seen.add(at)
        counted = read(at, 8 if wide else 2)
        n, entry = number(counted), 4 + 2 * width
        if len(counted) < (8 if wide else 2) or n > 1 << 16:
            return None
        rows = read(at + len(counted), n * entry + width)
        found = {}
        for k in range(0, min(n * entry, len(rows) - entry + 1), entry):
            tag, kind, count = number(rows[k : k + 2]), number(rows[k + 2 : k + 4]), number(rows[k + 4 : k + 4 + width])
            if tag in (WIDTH, HEIGHT) and kind in NUMBERS and count == 1:
                found[tag] = number(rows[k + 4 + width : k + 4 + width + NUMBERS[kind]])
        if found.get(WIDTH) and found.get(HEIGHT):
            return found[WIDTH], found[HEIGHT]
        at = number(rows[n * entry : n * entry + width]) if len(rows) >= n * entry + width else 0
    return None


def boxes(read: Read, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start, end) of the contents of the boxes between two places; a box of size 0 goes to the end."""
    for _ in range(MOST):
        head = read(at, 16)
        if at + 8 > end or len(head) < 8:
            return
        size, start = _big(head[:4]), at + 8
        if size == 1:
            size, start = _big(head[8:16]), at + 16
        stop = end if size == 0 else at + size
        if stop < start or stop > end:
            return
        yield head[4:8], start, stop
        at = stop


def _first(read: Read, kind: bytes, at: int, end: int) -> tuple[int, int] | None:
    return next(((a, b) for k, a, b in boxes(read, at, end) if k == kind), None)


def _owned(raw: bytes, item: int) -> list[int]:
    """Which properties (from 1) a table of associations gives an item."""
    version, long = raw[0], raw[3] & 1
    at, out = 8, []
    for _ in range(_big(raw[4:8])):
        name = 2 if version < 1 else 4
        if at + name + 1 > len(raw):
            break
        own, n = _big(raw[at : at + name]), raw[at + name]
        at += name + 1
        for _ in range(n):
            k = _big(raw[at : at + 1 + long]) & (0x7FFF if long else 0x7F)
            at += 1 + long
            if own == item:
                out.append(k)
    return out


def _boxed(read: Read, size: int) -> Size:
    """The spatial extent of the primary picture; without a primary one, the largest of all."""
    meta = _first(read, b"meta", 0, size)
    if meta is None:
        return None
    inside = {k: (a, b) for k, a, b in boxes(read, meta[0] + 4, meta[1])}
    if b"iprp" not in inside:
        return None
    listed = _first(read, b"ipco", *inside[b"iprp"])
    if listed is None:
        return None
    extents = {}
    for k, (kind, a, b) in enumerate(boxes(read, *listed), 1):
        if kind == b"ispe" and b - a >= 12:
            raw = read(a, 12)
            extents[k] = _big(raw[4:8]), _big(raw[8:12])
    if b"pitm" in inside:
        raw = read(*_range(inside[b"pitm"], 8))
        primary = _big(raw[4:6] if raw[:1] == b"\0" else raw[4:8])
        for kind, a, b in boxes(read, *inside[b"iprp"]):
            if kind == b"ipma":
                own = [extents[k] for k in _owned(read(*_range((a, b), 1 << 20)), primary) if k in extents]
                if own:
                    return own[0]
    return max(extents.values(), key=lambda e: e[0] * e[1], default=None)


def _range(place: tuple[int, int], most: int) -> tuple[int, int]:
    return place[0], min(place[1] - place[0], most)


def header_size(head: bytes, read: Read, size: int) -> Size:
    """Width and height that a file's header states; None if it states none that can be read."""
    found = None
    if head.startswith(b"\x89PNG") and len(head) >= 24:
        found = _big(head[16:20]), _big(head[20:24])
    elif head[:6] in (b"GIF87a", b"GIF89a") and len(head) >= 10:
        found = _little(head[6:8]), _little(head[8:10])
    elif head.startswith(b"BM") and len(head) >= 26:
        found = int.from_bytes(head[18:22], "little", signed=True), abs(int.from_bytes(head[22:26], "little", signed=True))
    elif head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        found = _webp(read(0, 32))
    elif head[:4] in (b"II*\0", b"MM\0*", b"II+\0", b"MM\0+") and len(head) >= 8:
        found = _tiff(read(0, 16), read)
    elif head[4:8] == b"ftyp" and any(b in head[8:] for b in BRANDS):
        found = _boxed(read, size)
    elif head.startswith(b"\xff\xd8"):
        found = _jpeg(read, size)
    return found if found and found[0] > 0 and found[1] > 0 else None
