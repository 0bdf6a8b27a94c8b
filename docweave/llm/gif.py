"""Operator 6: GIF images as timed frames with colour histograms.

A file is read block by block: screen and palettes, graphic control with delay, transparency and disposal, images with local
palettes and interlacing. LZW code streams are decoded to palette indices, which are drawn over the canvas; a frame is the canvas
after its image, as RGBA bytes. Disposal happens before the next image: 2 clears the image's rectangle, 3 brings back what was there before.
As viewers do, the canvas starts transparent, and clearing makes it transparent.

Edge cases: null data gives one row without a frame and the error "null"; data that is no GIF, or breaks off, gives the frames up to there and
one row without a frame that names the error; a file without images gives one row with the error "no image"; pixels that a short code stream doesn't
reach are left as they were, and those beyond an image are dropped; images that reach over the canvas are cut; palette indices without a colour
are black; delays of 0 are kept. Canvases or images of more than max_pixels, a parameter of decode(), give a row with an error in place of frames, since a
few bytes can declare 17 GB. Repeated rows each give their frames; an empty table gives an empty result. Only the two named columns are read, whatever other columns are called.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import slices

#: Pixels of the largest canvas or image that is decoded unless told otherwise; its frames are 256 MB each.
MAX_PIXELS = 1 << 26
#: Levels of red, green and blue in a histogram.
LEVELS = 4
FRAMES = "frame int, start_ms bigint, delay_ms int, width int, height int, rgba binary, histogram array<int>, transparent int, error string"


class GifError(ValueError):
    pass


def lzw_decode(size: int, data: bytes, limit: int) -> bytes:
    """At most limit palette indices of a code stream whose roots have size bits."""
    clear, end = 1 << size, (1 << size) + 1
    roots = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, wide = roots.copy(), size + 1
    full, have, bits, n = 1 << wide, 0, 0, 0
    mask = full - 1
    out: list[bytes] = []
    last = b""
    for byte in data:
        bits |= byte << have
        have += 8
        while have >= wide:
            code = bits & mask
            bits >>= wide
            have -= wide
            if code == clear:
                table, wide, last = roots.copy(), size + 1, b""
                full = 1 << wide
                mask = full - 1
                continue
            if code == end:
                return b"".join(out)[:limit]
            if not last:
                if code > end:
                    raise GifError("code without a predecessor")
                now = table[code]
            elif code < len(table):
                now = table[code]
                if len(table) < 4096:
                    table.append(last + now[:1])
            elif code == len(table) and code < 4096:
                now = last + last[:1]
                table.append(now)
            else:
                raise GifError("code outside the table")
            if len(table) == full and wide < 12:
                wide += 1
                full = 1 << wide
                mask = full - 1
            out.append(now)
            last = now
            n += len(now)
            if n >= limit:
                return b"".join(out)[:limit]
    return b"".join(out)


def lzw_encode(size: int, indices: bytes) -> bytes:
    """The code stream of palette indices below 2**size."""
    clear, end = 1 << size, (1 << size) + 1
    out, bits, have, wide = bytearray(), clear, size + 1, size + 1
    table: dict[int, int] = {}
    following = end + 1

    def put(code: int) -> None:
        nonlocal bits, have
        bits |= code << have
        have += wide
        while have >= 8:
            out.append(bits & 255)
            bits >>= 8
            have -= 8

    run = -1
    for i in indices:
        if run < 0:
            run = i
            continue
        key = run << 8 | i
        if (known := table.get(key)) is not None:
            run = known
            continue
        put(run)
        if following < 4096:
            table[key] = following
            if following == 1 << wide and wide < 12:
                wide += 1
            following += 1
        else:
            put(clear)
            table, wide, following = {}, size + 1, end + 1
        run = i
    if run >= 0:
        put(run)
        if following == 1 << wide and wide < 12:  # the decoder adds an entry here too
            wide += 1
    put(end)
    if have:
        out.append(bits & 255)
    return bytes(out)


def _rows(height: int) -> np.ndarray:
    """Where the rows of an interlaced image go."""
    return np.concatenate([np.arange(a, height, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])


def frames(data: bytes, max_pixels: int = MAX_PIXELS):
    """Yields (delay in ms, canvas of height x width x 4) for each image; the canvas is used again. Raises GifError where the file is broken."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise GifError("no GIF")
    if len(data) < 13:
        raise GifError("breaks off")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    if width * height > max_pixels:
        raise GifError("too many pixels")
    at = 13

    def palette(bits: int) -> np.ndarray:
        nonlocal at
        size = 3 << bits + 1
        if at + size > len(data):
            raise GifError("breaks off")
        colours = np.zeros((256, 4), np.uint8)
        colours[:, 3] = 255
        colours[: size // 3, :3] = np.frombuffer(data, np.uint8, size, at).reshape(-1, 3)
        at += size
        return colours

    def blocks() -> bytes:
        nonlocal at
        parts = []
        while True:
            if at >= len(data) or at + 1 + data[at] > len(data):
                raise GifError("breaks off")
            n = data[at]
            if not n:
                at += 1
                return b"".join(parts)
            parts.append(data[at + 1 : at + 1 + n])
            at += 1 + n

    common = palette(flags & 7) if flags & 128 else None
    canvas = np.zeros((height, width, 4), np.uint8)
    delay, disposal, clear_index = 0, 0, -1
    undo = None
    while True:
        if at >= len(data):
            raise GifError("breaks off")
        kind = data[at]
        at += 1
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at] if at < len(data) else 0
            at += 1
            body = blocks()
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, 10 * (body[1] | body[2] << 8)
                clear_index = body[3] if body[0] & 1 else -1
            continue
        if kind != 0x2C:
            raise GifError(f"block {kind:#x}")
        if at + 9 > len(data):
            raise GifError("breaks off")
        x, y, w, h, own = struct.unpack_from("<HHHHB", data, at)
        at += 9
        if w * h > max_pixels:
            raise GifError("too many pixels")
        colours = palette(own & 7) if own & 128 else common
        if colours is None:
            colours = np.zeros((256, 4), np.uint8)
            colours[:, 3] = 255
        if at >= len(data) or not 1 <= data[at] <= 8:
            raise GifError("code size")
        size = data[at]
        at += 1
        indices = np.frombuffer(lzw_decode(size, blocks(), w * h), np.uint8)
        if undo is not None:  # the disposal of the image before
            rectangle, saved = undo
            canvas[rectangle] = saved
            undo = None
        drawn = np.zeros(w * h, bool)
        drawn[: len(indices)] = indices != clear_index
        flat = np.zeros(w * h, np.uint8)
        flat[: len(indices)] = indices
        flat, drawn = flat.reshape(h, w), drawn.reshape(h, w)
        if own & 64 and h:
            straight, shown = np.empty_like(flat), np.empty_like(drawn)
            straight[_rows(h)], shown[_rows(h)] = flat, drawn
            flat, drawn = straight, shown
        rectangle = (slice(y, min(y + h, height)), slice(x, min(x + w, width)))
        part = canvas[rectangle]
        if disposal == 3:
            undo = (rectangle, part.copy())
        elif disposal == 2:
            undo = (rectangle, 0)
        seen = drawn[: part.shape[0], : part.shape[1]]
        part[seen] = colours[flat[: part.shape[0], : part.shape[1]][seen]]
        yield delay, canvas
        delay, disposal, clear_index = 0, 0, -1


def histogram(canvas: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, int]:
    """Opaque pixels by (red, green, blue) level, and how many pixels are transparent."""
    opaque = canvas[..., 3] > 0
    c = canvas[opaque].astype(np.int64)[:, :3] * levels >> 8
    return np.bincount((c[:, 0] * levels + c[:, 1]) * levels + c[:, 2], minlength=levels**3), int(opaque.size - opaque.sum())


def encode(width: int, height: int, palette: np.ndarray, images: list[dict]) -> bytes:
    """A GIF of images: {x, y, pixels (h x w indices), delay in ms, disposal, transparent, interlaced, palette}."""

    def table(colours) -> tuple[int, bytes]:
        bits = max(1, int(np.ceil(np.log2(max(2, len(colours))))))
        full = np.zeros((1 << bits, 3), np.uint8)
        full[: len(colours)] = colours
        return bits, full.tobytes()

    bits, colours = table(palette)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0x80 | bits - 1, 0, 0), colours]
    for im in images:
        clear = im.get("transparent", -1)
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", im.get("disposal", 0) << 2 | (clear >= 0), im.get("delay", 0) // 10, max(clear, 0)) + b"\0")
        pixels = np.asarray(im["pixels"], np.uint8)
        h, w = pixels.shape
        own = im.get("palette")
        flags, local, size = 0, b"", bits
        if own is not None:
            size, local = table(own)
            flags = 0x80 | size - 1
        if im.get("interlaced"):
            flags |= 64
            pixels = pixels[_rows(h)]
        size = max(2, size)
        codes = lzw_encode(size, pixels.tobytes())
        out.append(b"\x2c" + struct.pack("<HHHHB", im.get("x", 0), im.get("y", 0), w, h, flags) + local + bytes([size]))
        out += [bytes([len(codes[i : i + 255])]) + codes[i : i + 255] for i in range(0, len(codes), 255)]
        out.append(b"\0")
    return b"".join(out) + b"\x3b"


_RAMP = np.array([[17 * i, 255 - 17 * i, 8 * i] for i in range(16)], np.uint8)
_LOCAL = np.array([[255, 80 * i, 30 * i] for i in range(4)], np.uint8)


def picture(text: str) -> bytes:
    """A GIF of three frames that shows how often bytes, and pairs of neighbouring bytes, stand in a text; every byte of it counts."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64)
    by = np.bincount(raw, minlength=256).reshape(16, 16)
    pairs = np.bincount((raw[:-1] >> 5) * 8 + (raw[1:] >> 5), minlength=64).reshape(8, 8)
    level = lambda x: np.minimum(15, np.log2(x + 1.0)).astype(np.uint8)
    return encode(
        16,
        16,
        _RAMP,
        [
            {"pixels": level(by), "delay": 100, "disposal": 1},
            {"pixels": level(pairs), "x": 4, "y": 4, "delay": 200, "disposal": 2, "transparent": 0},
            {"pixels": level(pairs.T) & 3, "x": 2, "y": 6, "delay": 50, "disposal": 3, "transparent": 1, "interlaced": True, "palette": _LOCAL},
        ],
    )


def pictures(pages: DataFrame) -> DataFrame:
    """(page_id, gif): the picture of each page's html; null for a null page."""

    def run(batches):
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if t is None else picture(t) for t in part.column(1).to_pylist()], pa.binary())], names=["page_id", "gif"])

    return pages.select("page_id", "html").mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, gif binary")


def decode(media: DataFrame, key: str = "page_id", column: str = "gif", max_pixels: int = MAX_PIXELS) -> DataFrame:
    """(key, frame, start_ms, delay_ms, width, height, rgba, histogram, transparent, error): a row for each frame. No shuffle."""
    names = [key, *(x.split()[0] for x in FRAMES.split(", "))]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.int32(), pa.string()]

    def rows(data):
        if data is None:
            yield (*[None] * 8, "null")
            return
        k, start, error = 0, 0, None
        try:
            for delay, canvas in frames(data, max_pixels):
                counts, clear = histogram(canvas)
                yield k, start, delay, canvas.shape[1], canvas.shape[0], canvas.tobytes(), counts, clear, None
                k, start = k + 1, start + delay
            if not k:
                error = "no image"
        except GifError as x:
            error = str(x)
        if error:
            yield (*[None] * 8, error)

    def run(batches):
        for part in slices(batches, 64):
            of, held, size = [], [], 0
            for i, data in enumerate(part.column(1).to_pylist()):
                for row in rows(data):
                    of.append(i)
                    held.append(row)
                    size += len(row[5] or b"")
                    if size > 32_000_000:  # frames of large images leave at once
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), *(pa.array(c, t) for c, t in zip(zip(*held), kinds))], names=names)
                        of, held, size = [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), *(pa.array(c, t) for c, t in zip(zip(*held), kinds))], names=names)

    return media.select(F.col(key), F.col(column)).mapInArrow(run, f"`{key}` {media.schema[key].dataType.simpleString()}, {FRAMES}")
