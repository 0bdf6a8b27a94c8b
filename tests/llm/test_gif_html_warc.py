from __future__ import annotations

import base64
import gzip
import hashlib
import random

import numpy as np
import pytest

from docweave.llm import gif, html, warc

CRLF = b"\r\n"


# GIF


def naive(width, height, palette, images):
    """Frames drawn pixel by pixel from the same description."""
    canvas, out, undo = {}, [], None
    for im in images:
        if undo is not None:
            canvas = undo
        before = dict(canvas)
        own = im.get("palette", palette)
        px, box = np.asarray(im["pixels"]), set()
        for r in range(px.shape[0]):
            for c in range(px.shape[1]):
                at = (im.get("y", 0) + r, im.get("x", 0) + c)
                if at[0] < height and at[1] < width:
                    box.add(at)
                    if px[r, c] != im.get("transparent", -1):
                        canvas[at] = (*(map(int, own[px[r, c]]) if px[r, c] < len(own) else (0, 0, 0)), 255)
        frame = np.zeros((height, width, 4), np.uint8)
        for at, colour in canvas.items():
            frame[at] = colour
        out.append((im.get("delay", 0), frame))
        kind = im.get("disposal", 0)
        undo = before if kind == 3 else {k: v for k, v in canvas.items() if k not in box} if kind == 2 else None
    return out


@pytest.mark.parametrize("seed", range(12))
def test_frames_match_naive_drawing(seed):
    rng = np.random.default_rng(seed)
    w, h, n = int(rng.integers(1, 40)), int(rng.integers(1, 40)), int(rng.choice([2, 4, 16, 256]))
    palette = rng.integers(0, 256, (n, 3))
    images = []
    for _ in range(int(rng.integers(1, 6))):
        shape = (int(rng.integers(1, h + 3)), int(rng.integers(1, w + 3)))
        im = {"x": int(rng.integers(0, w)), "y": int(rng.integers(0, h)), "delay": 10 * int(rng.integers(0, 300)), "disposal": int(rng.integers(0, 4)), "interlaced": bool(rng.integers(0, 2))}
        if rng.integers(0, 2):
            im["palette"] = rng.integers(0, 256, (4, 3))
        k = min(len(im.get("palette", palette)), n)
        im["pixels"] = rng.integers(0, k, shape)
        if rng.integers(0, 2):
            im["transparent"] = int(rng.integers(0, k))
        images.append(im)
    got = [(d, c.copy()) for d, c in gif.frames(gif.encode(w, h, palette, images))]
    want = naive(w, h, palette, images)
    assert len(got) == len(want)
    for (d, a), (e, b) in zip(got, want):
        assert d == e and (a == b).all()
        counts, clear = gif.histogram(a)
        assert counts.sum() + clear == w * h


@pytest.mark.parametrize("size", [2, 4, 8])
def test_lzw_round_trip(size):
    rng = random.Random(size)
    for n in (0, 1, 2, 255, 5000, 40_000):
        for runs in (1, 40):
            x = bytes(rng.randrange(1 << size) for _ in range(n // runs + 1) for _ in range(1)) * runs
            x = x[:n]
            assert gif.lzw_decode(size, gif.lzw_encode(size, x), n) == x


def test_broken_images(spark):
    fine = gif.picture("some text")
    huge = b"GIF89a" + b"\xff" * 4 + bytes([0, 0, 0])
    rows = [(1, None), (2, b""), (3, b"PNG"), (4, fine[:-60]), (5, fine), (5, fine), (6, b"GIF89a\x01\0\x01\0\0\0\0;"), (7, huge), (8, fine[:-1])]
    df = spark.createDataFrame([(i, b and bytearray(b), "x") for i, b in rows], "page_id bigint, gif binary, frame string")
    got = gif.decode(df).collect()
    errors = {r["page_id"]: r["error"] for r in got if r["error"]}
    assert errors == {1: "null", 2: "no GIF", 3: "no GIF", 4: "breaks off", 6: "no image", 7: "too many pixels", 8: "breaks off"}
    assert [(r["frame"], r["start_ms"], r["delay_ms"]) for r in sorted(got, key=lambda r: r["frame"] or 0) if r["page_id"] == 5 and not r["error"]] == [(0, 0, 100)] * 2 + [(1, 100, 200)] * 2 + [(2, 300, 50)] * 2
    assert gif.decode(df.limit(0)).count() == 0
    assert gif.pictures(spark.createDataFrame([(1, None), (2, "")], "page_id bigint, html string")).where("gif is null").count() == 1


# HTML

LONG = "the man and the dog are in the house and they have been there for a long time with all of the others " * 3
MEDIUM = "the man and the dog are in the house and they have been there for a long time"
RARE = "zebra quokka numbat potoroo bilby wombat echidna platypus dingo kangaroo koala possum glider bettong"


def slow_second_pass(labels):
    out = []
    for i, x in enumerate(labels):
        sides = [[(abs(j - i), labels[j]) for j in js if labels[j] in ("good", "bad")][:1] for js in (range(i - 1, -1, -1), range(i + 1, len(labels)))]
        near = [s[0] for s in sides if s]
        if x in ("good", "bad"):
            out.append(x == "good")
        elif x == "nearly":
            out.append(any(y == "good" for _, y in near) or not near)
        else:
            best = min((d for d, _ in near), default=0)
            out.append(bool(near) and {y for d, y in near if d == best} == {"good"})
    return out


def test_second_pass_is_nearest():
    rng = random.Random(2)
    for _ in range(500):
        labels = [rng.choice(["good", "bad", "short", "nearly"]) for _ in range(rng.randrange(12))]
        assert html.second_pass(labels) == slow_second_pass(labels)


def test_blocks_and_labels():
    page = f"""<!DOCTYPE html><html lang=en><head><title>no</title><style>p{{a:b}}</style><script>if (a < b) x("</p>")</script></head><body>
    <nav><a href="/x">home</a> <a href='/y>z'>more</a></nav><!-- <p>hidden</p> --><h1>A &amp; title</h1><p>{LONG}<b>bold</b>ly</p>
    <p>{MEDIUM}<br>next<br><br>after</p><p>{RARE}</p><div>&copy; {LONG}</div><p>short end<p>{LONG}"""
    found = html.blocks(page)
    assert [t[:8] for t, _ in found] == ["home mor", "A & titl", "the man ", "the man ", "after", "zebra qu", "© the ma", "short en", "the man "]
    assert found[0][1] == 8 and found[2][0].endswith("others boldly") and found[3][0].endswith("time next")
    text, labels, good = html.extract(page)
    assert labels == ["bad", "short", "good", "nearly", "short", "bad", "bad", "short", "good"]
    assert good == [False, False, True, True, False, False, False, False, True] and text.count("\n") == 2


@pytest.mark.parametrize("page", ["<" * 200_000, "<a" * 100_000, "<!--" * 50_000, '<p class="' * 50_000, "<script>" * 50_000, "a < b " * 50_000, "</" * 100_000])
def test_odd_pages_take_linear_time(page):
    html.extract(page)


def test_pages(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, f"<p>{LONG}", "c"), (3, f"<p>{LONG}", "c"), (None, "plain", "d")], "page_id bigint, html string, text string")
    got = {(r["page_id"], r["text"], r["n_blocks"], r["n_good"]) for r in html.text_of(df).collect()}
    assert got == {(1, None, None, None), (2, "", 0, 0), (3, LONG.strip(), 1, 1), (None, "", 1, 0)}
    assert html.text_of(df.limit(0)).count() == 0


# WARC


def record(payload, url="http://x/", kind=b"application/http; msgtype=response", digest=None, length=None):
    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n" if b"http" in kind else b""
    digest = b"sha256:" + hashlib.sha256(payload).hexdigest().encode() if digest is None else digest
    n = len(http) + len(payload) if length is None else length
    return b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: " + url.encode() + b"\r\nwarc-payload-digest: " + digest + b"\r\nContent-Type: " + kind + b"\r\nContent-Length: " + str(n).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def test_archive(spark):
    a, b = b"payload \xff\x00\xe9 one", "größer".encode()
    rows = [(1, record(a)), (2, record(a, "http://other/")), (2, record(a, "http://other/")), (3, record(b, kind=b"text/plain")), (4, record(b, digest=b"sha256:" + b"0" * 64)), (5, b""), (6, b"no end"), (7, record(a, length=10_000)), (None, record(b"lost")), (9, record(b"", digest=b"sha1:X")), (10, b"WARC/1.0\r\nX: y\r\n\r\nto the end"), (11, None)]
    df = spark.createDataFrame([(i, r if r is None else bytearray(r), "x") for i, r in rows], "record_id bigint, record binary, digest string").repartition(3)
    headers, payloads = warc.store(df)
    assert headers.count() == len(rows)
    stored = {r["digest"]: (r["owner"], bytes(r["payload"])) for r in payloads.collect()}
    assert payloads.count() == len(stored) and all(hashlib.sha256(p).hexdigest() == d for d, (_, p) in stored.items())
    assert {p for _, p in stored.values()} == {a, b, b"", b"lost", b"to the end"}
    assert stored[hashlib.sha256(a).hexdigest()][0] == 1 and stored[hashlib.sha256(b).hexdigest()][0] == 3
    back = warc.restore(headers, payloads).collect()
    assert sorted((r["record_id"] or 0, r["record"] and bytes(r["record"])) for r in back if r["record_id"] != 11) == sorted((i or 0, r) for i, r in rows if i != 11)
    fits = {r["record_id"]: r["declared_fits"] for r in back}
    assert fits[1] and fits[3] and fits[4] is False and fits[9] is None and all(r["verified"] for r in back if r["record_id"] != 11)
    assert next(r for r in back if r["record_id"] == 11)["record"] is None
    empty = warc.store(df.limit(0))
    assert warc.restore(*empty).count() == 0


def test_files(spark, tmp_path):
    rs = [record(b"one"), record(b"two" * 1000), record(b"\r\n\r\n")]
    (tmp_path / "a.warc").write_bytes(b"".join(rs))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, rs)))
    got = warc.read(spark, str(tmp_path)).collect()
    assert sorted(bytes(r["record"]) for r in got) == sorted(rs * 2) and len({r["record_id"] for r in got}) == 6


def test_pages_as_records(spark):
    df = spark.createDataFrame([(1, "http://a/\r\nX: y", "é"), (2, None, None), (None, "u", "é")], "page_id bigint, url string, html string")
    back = warc.restore(*warc.store(warc.from_pages(df))).collect()
    assert {(r["record_id"], r["payload_bytes"], r["verified"], r["declared_fits"]) for r in back} == {(1, 2, True, True), (2, 0, True, True), (None, 2, True, True)}


def test_broken_files(spark, tmp_path):
    """What can be unpacked of a file is read, whatever stands behind it."""
    rs = [record(f"payload {i} ".encode() * (1 + 3000 * i)) for i in range(4)]
    whole = b"".join(map(gzip.compress, rs))
    cases = {"cut": whole[:-40], "behind": whole + b"no member", "broken": whole[: len(gzip.compress(rs[0]))] + b"\x1f\x8b" + b"\xff" * 50, "empty": b"", "one": b"\x1f"}
    for size in (7, 1 << 20):
        read = {k: list(warc.split_stream(x[i : i + size] for i in range(0, len(x), size))) for k, x in cases.items()}
        assert read["cut"][:3] == rs[:3] and len(read["cut"]) == 4 and rs[3].startswith(read["cut"][3][:5000])
        assert read["behind"] == [*rs, b"no member"] and read["broken"][0] == rs[0]
        assert read["empty"] == [] and read["one"] == [b"\x1f"]
    for k, x in cases.items():
        (tmp_path / f"{k}.warc.gz").write_bytes(x)
    got = warc.read(spark, str(tmp_path), 1000)
    assert got.count() == sum(map(len, read.values()))
    back = warc.restore(*warc.store(got))
    assert sorted(r["record"] for r in back.collect()) == sorted(r["record"] for r in got.collect())


def test_declared_digests():
    body = b"some payload"
    sha1 = hashlib.sha1(body).digest()
    for said, right in ((b"sha1:" + base64.b32encode(sha1), True), (b"SHA-1:" + sha1.hex().encode(), True), (b"sha1:" + base64.b32encode(bytes(20)), False), (b"md5:" + hashlib.md5(body).hexdigest().encode(), True), (b"crc:12", None)):
        assert warc._declared(b"WARC/1.0\r\nWARC-Payload-Digest: " + said + b"\r\n", body) is right


def test_files_of_other_encoders():
    """Two well-known small files, as bytes."""
    ten = bytes.fromhex("4749463839610A000A00910000FFFFFFFF00000000FF00000021F90400000000002C000000000A000A000002168C2D99872A1CDC33A00275EC95FAA8DE608C04914C01003B")
    (delay, canvas), *more = ((d, c.copy()) for d, c in gif.frames(ten))
    assert not more and delay == 0 and canvas.shape == (10, 10, 4)
    colour = {(255, 255, 255): "0", (255, 0, 0): "1", (0, 0, 255): "2", (0, 0, 0): "3"}
    assert ["".join(colour[tuple(map(int, p[:3]))] for p in row) for row in canvas] == ["1111122222"] * 3 + ["1110000222"] * 2 + ["2220000111"] * 2 + ["2222211111"] * 3
    one = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\xff\xff\xff\x00\x00\x00!\xf9\x04\x01\x00\x00\x00\x00,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"
    (delay, canvas), *more = gif.frames(one)
    assert not more and canvas.shape == (1, 1, 4)
    assert [f[1].shape for f in gif.frames(one.replace(b"GIF89a", b"GIF87a"))] == [(1, 1, 4)]


def test_full_table_without_clear():
    """An encoder may go on with a full table and never clear it."""
    rng = np.random.default_rng(2)
    pixels = rng.integers(0, 256, (120, 120)).astype(np.uint8)
    table, out, bits, have, wide = {bytes([i]): i for i in range(256)}, bytearray(), 0, 0, 9

    def put(code):
        nonlocal bits, have
        bits |= code << have
        have += wide
        while have >= 8:
            out.append(bits & 255)
            bits, have = bits >> 8, have - 8

    put(256)
    following, run = 258, b""
    for p in pixels.tobytes():
        longer = run + bytes([p])
        if longer in table:
            run = longer
            continue
        put(table[run])
        if following < 4096:
            table[longer] = following
            following += 1
            if following > 1 << wide and wide < 12:
                wide += 1
        run = bytes([p])
    put(table[run])
    put(257)
    out.append(bits & 255)
    palette = np.stack([np.arange(256)] * 3, 1).astype(np.uint8)
    head = b"GIF87a" + bytes([120, 0, 120, 0, 0xF7, 0, 0]) + palette.tobytes() + b"\x2c" + bytes([0, 0, 0, 0, 120, 0, 120, 0, 0, 8])
    body = b"".join(bytes([len(out[i : i + 255])]) + bytes(out[i : i + 255]) for i in range(0, len(out), 255)) + b"\x00\x3b"
    assert following == 4096 and np.array_equal(next(iter(gif.frames(head + body)))[1][:, :, 0], pixels)
    with pytest.raises(gif.GifError, match="pixels"):
        list(gif.frames(head + body, 1000))
