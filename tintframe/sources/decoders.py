"""Decoders of PNG, GIF, TIFF and BMP files into packed colours, as array steps.

Each takes the bytes of a file and returns rows of packed ARGB; what is wrong with a file is
said by an :class:`ImageError`, whatever the file holds.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np

# ISO media brands of still images.
AVIF_BRANDS = ("avif", "avis")
HEIF_BRANDS = ("heic", "heix", "hevc", "hevx", "heim", "heis", "hevm", "hevs", "mif1", "msf1")
#: Pixels of an image at most: a header may claim any size.
MOST_PIXELS = 1 << 28


class ImageError(ValueError):
    """``kind``: ``unknown`` (no image format), ``unsupported`` (no decoder for it) or ``broken``."""

    def __init__(self, kind: str, text: str):
        super().__init__(text)
        self.kind = kind


def _require(sound: bool, text: str) -> None:
    if not sound:
        raise ImageError("broken", text)


def _sized(width: int, height: int) -> None:
    _require(0 < width and 0 < height and width * height <= MOST_PIXELS, f"a size of {width} by {height}")


def packed(r, g, b, a=255) -> np.ndarray:
    """Bytes of channels to packed colours."""
    r, g, b, a = (np.asarray(c).astype(np.uint32) for c in (r, g, b, a))
    return ((a << np.uint32(24)) | (r << np.uint32(16)) | (g << np.uint32(8)) | b).astype(np.uint32).view(np.int32)


#: First bytes of formats; fixed values.
_SIGNATURES = (
    ("Png", b"\x89PNG\r\n\x1a\n"), ("Jpeg", b"\xff\xd8\xff"), ("Gif", b"GIF87a"), ("Gif", b"GIF89a"),
    ("Bmp", b"BM"), ("Tiff", b"II*\0"), ("Tiff", b"MM\0*"), ("Psd", b"8BPS"),
)


def sniff(data: bytes) -> str:
    """``images.image_format`` of bytes in a task."""
    if len(data) < 4:
        return "Unknown"
    for name, head in _SIGNATURES:
        if data.startswith(head):
            return name
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "Webp"
    brand = data[8:12].decode("latin-1") if data[4:8] == b"ftyp" else ""
    return "Avif" if brand in AVIF_BRANDS else "Heif" if brand in HEIF_BRANDS else "Unknown"


# ---- PNG


def unfiltered(raw: np.ndarray, filters: np.ndarray, step: int) -> np.ndarray:
    """Rows of a PNG before filtering. ``raw``: rows of bytes; ``step``: bytes of a pixel.

    A byte depends on those to the left, above and above left. So all bytes on one diagonal of
    (row, pixel) are worked out at a time, whatever the rows' filters.
    """
    height, width = raw.shape
    pixels = -(-width // step)
    out = np.zeros((height + 1, pixels + 1, step), np.int16)
    given = np.zeros((height, pixels * step), np.int16)
    given[:, :width] = raw
    given = given.reshape(height, pixels, step)
    kind = filters[:, None]
    for diagonal in range(height + pixels - 1):
        y = np.arange(max(0, diagonal - pixels + 1), min(height, diagonal + 1))
        x = diagonal - y
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        base = left + up - corner
        to_left, to_up, to_corner = np.abs(base - left), np.abs(base - up), np.abs(base - corner)
        paeth = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))
        of = kind[y]
        guess = np.where(of == 1, left, np.where(of == 2, up, np.where(of == 3, (left + up) >> 1, np.where(of == 4, paeth, 0))))
        out[y + 1, x + 1] = (given[y, x] + guess) & 255
    return out[1:, 1:].reshape(height, -1)[:, :width].astype(np.uint8)


def _samples(rows: np.ndarray, width: int, depth: int, channels: int) -> np.ndarray:
    """Rows of bytes to samples: of 16 bits the upper byte, of fewer than 8 each by itself."""
    if depth == 16:
        rows = rows[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1)[:, : width * depth].reshape(len(rows), width, depth)
        rows = (bits @ (1 << np.arange(depth - 1, -1, -1))).astype(np.uint8)
    return rows.reshape(len(rows), width, channels)


_PASSES = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1))
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def decode_png(data: bytes) -> np.ndarray:
    """Any PNG: grey, colour and palette, 1 to 16 bits, with and without alpha, interlaced or not."""
    at, body, table, clear, head = 8, [], None, None, None
    while True:
        _require(at + 12 <= len(data), "the file ends early")
        size, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + size]
        _require(at + 12 + size <= len(data), "the file ends early")
        _require(zlib.crc32(kind + part) == struct.unpack_from(">I", data, at + 8 + size)[0], f"a checksum of {kind!r}")
        at += 12 + size
        if kind == b"IHDR":
            _require(size == 13, "its head")
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            _require(size % 3 == 0, "its palette")
            table = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = part
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"IEND":
            break
    _require(head is not None, "no head")
    width, height, depth, colour, _, _, interlaced = head
    _sized(width, height)
    _require(colour in _CHANNELS and depth in (1, 2, 4, 8, 16) and (depth >= 8 or colour in (0, 3)) and interlaced in (0, 1), "its kind of pixels")
    channels = _CHANNELS[colour]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    except zlib.error as wrong:
        raise ImageError("broken", f"its data: {wrong}") from wrong
    out = np.zeros((height, width, channels), np.uint8)
    low = np.zeros((height, width, channels), np.uint8) if depth == 16 else None
    start = 0
    for top, left, down, across in _PASSES if interlaced else ((0, 0, 1, 1),):
        rows, columns = -(-(height - top) // down), -(-(width - left) // across)
        if rows <= 0 or columns <= 0:
            continue
        length = -(-columns * channels * depth // 8)
        _require(start + rows * (length + 1) <= len(raw), "its data end early")
        lines = raw[start : start + rows * (length + 1)].reshape(rows, length + 1)
        start += rows * (length + 1)
        _require(int(lines[:, 0].max(initial=0)) <= 4, "a filter of a row")
        plain = unfiltered(lines[:, 1:], lines[:, 0], max(1, channels * depth // 8))
        out[top::down, left::across] = _samples(plain, columns, depth, channels)
        if low is not None:
            low[top::down, left::across] = plain[:, 1::2].reshape(rows, columns, channels)
    if colour == 3:
        _require(table is not None and int(out.max(initial=0)) < len(table), "an index beyond its palette")
        alpha = np.full(len(table), 255, np.uint8)
        if clear is not None:
            alpha[: len(clear)] = np.frombuffer(clear[: len(table)], np.uint8)
        shown = out[..., 0]
        return packed(*(table[shown, i] for i in range(3)), alpha[shown])
    alpha = out[..., -1] if colour in (4, 6) else np.full((height, width), 255, np.uint8)
    if clear is not None and colour in (0, 2):
        _require(len(clear) == 2 * channels, "its transparent colour")
        wanted = np.frombuffer(clear, ">u2")
        exact = out.astype(np.uint16) if low is None else out.astype(np.uint16) << 8 | low
        alpha = np.where((exact == wanted).all(axis=2), 0, 255)
    level = out if depth >= 8 else out * np.uint8(255 // ((1 << depth) - 1))
    r, g, b = (level[..., i] for i in ((0, 0, 0) if colour in (0, 4) else (0, 1, 2)))
    return packed(r, g, b, alpha)


# ---- GIF


def unpacked_lzw(data: bytes, first_bits: int, expected: int) -> np.ndarray:
    """Indices of a GIF's compressed data, ``expected`` of them."""
    _require(2 <= first_bits <= 8, "its code size")
    clear, end = 1 << first_bits, (1 << first_bits) + 1
    roots = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, bits, last = list(roots), first_bits + 1, b""
    out = bytearray()
    held = count = 0
    for byte in data:
        held |= byte << count
        count += 8
        while count >= bits:
            code = held & ((1 << bits) - 1)
            held >>= bits
            count -= bits
            if code == clear:
                table, bits, last = list(roots), first_bits + 1, b""
                continue
            if code == end or len(out) >= expected:
                _require(len(out) >= expected, "its data end early")
                return np.frombuffer(bytes(out[:expected]), np.uint8)
            if code < len(table):
                entry = table[code]
            else:
                _require(code == len(table) and bool(last), "a code that is not there yet")
                entry = last + last[:1]
            out += entry
            if last and len(table) < 4096:
                table.append(last + entry[:1])
                if len(table) == 1 << bits and bits < 12:
                    bits += 1
            last = entry
    _require(len(out) >= expected, "its data end early")
    return np.frombuffer(bytes(out[:expected]), np.uint8)


def decode_gif(data: bytes) -> np.ndarray:
    """The first picture of a GIF on its canvas; what it does not cover is transparent."""

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while True:
            _require(at < len(data), "the file ends early")
            size = data[at]
            if not size:
                return b"".join(parts), at + 1
            parts.append(data[at + 1 : at + 1 + size])
            at += 1 + size

    _require(len(data) >= 13, "the file ends early")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    _sized(width, height)
    at, table, hidden = 13, None, None
    if flags & 0x80:
        size = 2 << (flags & 7)
        table = np.frombuffer(data[at : at + 3 * size].ljust(3 * size, b"\0"), np.uint8).reshape(size, 3)
        at += 3 * size
    while at < len(data):
        kind = data[at]
        if kind == 0x21:
            label = data[at + 1] if at + 1 < len(data) else 0
            body, at = blocks(at + 2)
            if label == 0xF9 and len(body) >= 4:
                hidden = body[3] if body[0] & 1 else None
        elif kind == 0x2C:
            _require(at + 11 <= len(data), "the file ends early")
            x, y, w, h, own = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            if own & 0x80:
                size = 2 << (own & 7)
                table = np.frombuffer(data[at : at + 3 * size].ljust(3 * size, b"\0"), np.uint8).reshape(size, 3)
                at += 3 * size
            _require(table is not None and w > 0 and h > 0 and at < len(data), "a picture without colours or size")
            body, _ = blocks(at + 1)
            index = unpacked_lzw(body, data[at], w * h).reshape(h, w)
            if own & 0x40:
                order = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
                straight = np.empty_like(index)
                straight[order] = index
                index = straight
            _require(int(index.max()) < len(table), "an index beyond its palette")
            shown = packed(*(table[index, i] for i in range(3)), np.where(index == hidden, 0, 255) if hidden is not None else np.full(index.shape, 255))
            canvas = np.zeros((height, width), np.int32)
            part = canvas[y : y + h, x : x + w]
            part[...] = shown[: part.shape[0], : part.shape[1]]
            return canvas
        else:
            break
    raise ImageError("broken", "no picture in it")


# ---- TIFF


def _unpacked_bits(data: bytes) -> bytes:
    """Apple's run lengths."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


_TIFF_SIZES = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}


def decode_tiff(data: bytes) -> np.ndarray:
    """The first picture of a TIFF in strips of 8-bit grey, colour or palette pixels.

    Plain, run lengths (PackBits) and deflated, with or without differences along rows.
    """
    order = "<" if data[:2] == b"II" else ">"
    try:
        at = struct.unpack_from(order + "I", data, 4)[0]
        tags: dict[int, tuple] = {}
        for i in range(struct.unpack_from(order + "H", data, at)[0]):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if kind in _TIFF_SIZES:
                code, size = _TIFF_SIZES[kind]
                _require(count * size <= len(data), "a field longer than the file")
                place = at + 10 + 12 * i
                place = place if count * size <= 4 else struct.unpack_from(order + "I", data, place)[0]
                tags[tag] = struct.unpack_from(f"{order}{count}{code}", data, place)
        width, height = tags[256][0], tags[257][0]
        strips, lengths = tags[273], tags[279]
    except (struct.error, KeyError) as wrong:
        raise ImageError("broken", "its directory") from wrong
    _sized(width, height)
    one = lambda tag, default: tags.get(tag, (default,))[0]
    packing, photometric, samples = one(259, 1), one(262, 1), one(277, 1)
    if packing not in (1, 8, 32773, 32946) or photometric > 3 or {*tags.get(258, (1,))} != {8} or one(284, 1) != 1 or samples < (3 if photometric == 2 else 1):
        raise ImageError("unsupported", "a TIFF of this kind has no decoder")
    unpack: Callable[[bytes], bytes] = {1: bytes, 32773: _unpacked_bits}.get(packing, zlib.decompress)
    try:
        raw = b"".join(unpack(data[a : a + n]) for a, n in zip(strips, lengths, strict=False))
    except zlib.error as wrong:
        raise ImageError("broken", f"its data: {wrong}") from wrong
    _require(len(raw) >= width * height * samples, "its data end early")
    px = np.frombuffer(raw, np.uint8, width * height * samples).reshape(height, width, samples)
    if one(317, 1) == 2:
        px = np.cumsum(px, axis=1, dtype=np.uint8)
    if photometric == 3:
        table = np.array(tags.get(320, ()), np.uint16)
        _require(len(table) == 768, "its palette")
        return packed(*((table.reshape(3, 256)[i, px[..., 0]] >> 8) for i in range(3)))
    if photometric == 2:
        return packed(px[..., 0], px[..., 1], px[..., 2], px[..., 3] if samples > 3 and 338 in tags else 255 + 0 * px[..., 0])
    grey = 255 - px[..., 0] if photometric == 0 else px[..., 0]
    return packed(grey, grey, grey, px[..., 1] if samples > 1 and 338 in tags else 255 + 0 * grey)


# ---- BMP


def decode_bmp(data: bytes) -> np.ndarray:
    """An uncompressed BMP of 24 or 32 bits."""
    _require(len(data) >= 54, "the file ends early")
    start, _, width, height, _, depth, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if depth not in (24, 32) or packing not in (0, 3):
        raise ImageError("unsupported", "not an uncompressed 24 or 32 bit BMP")
    _sized(width, abs(height))
    step = (width * depth // 8 + 3) // 4 * 4
    _require(start + step * abs(height) <= len(data), "the file ends early")
    rows = np.frombuffer(data, np.uint8, step * abs(height), start).reshape(abs(height), step)[:, : width * depth // 8]
    px = rows.reshape(abs(height), width, depth // 8)
    argb = packed(px[..., 2], px[..., 1], px[..., 0], px[..., 3] if depth == 32 else 255 + 0 * px[..., 0])
    return argb[::-1] if height > 0 else argb


DECODERS = {"Png": decode_png, "Gif": decode_gif, "Tiff": decode_tiff, "Bmp": decode_bmp}


def decode(data: bytes, name: str) -> np.ndarray:
    """Packed colours of a file whose format is ``name``; anything wrong is an :class:`ImageError`."""
    if name == "Unknown":
        raise ImageError("unknown", "not a supported image")
    if name not in DECODERS:
        raise ImageError("unsupported", f"there is no decoder for {name}")
    try:
        return DECODERS[name](data)
    except ImageError:
        raise
    except Exception as wrong:  # a damaged file may fail anywhere in a decoder
        raise ImageError("broken", f"{type(wrong).__name__}: {wrong}") from wrong
