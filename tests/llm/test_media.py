import hashlib
import struct
import zlib

import numpy as np
import pytest

from cytoplan.llm import media


def filtered(samples, kinds):
    """An independent encoder that applies given filters line by line, pixel by pixel."""
    h, w = samples.shape[:2]
    step = samples.shape[2] if samples.ndim == 3 else 1
    x = samples.reshape(h, w * step).astype(int)
    lines = []
    for r in range(h):
        line = []
        for i in range(w * step):
            a = x[r, i - step] if i >= step else 0
            b = x[r - 1, i] if r else 0
            c = x[r - 1, i - step] if r and i >= step else 0
            p = a + b - c
            paeth = min((abs(p - v), k, v) for k, v in enumerate((a, b, c)))[2]
            line.append((x[r, i] - (0, a, b, (a + b) // 2, paeth)[kinds[r]]) % 256)
        lines.append(bytes([kinds[r], *line]))
    return np.frombuffer(b"".join(lines), np.uint8).reshape(h, -1), step


@pytest.mark.parametrize("shape", [(7, 5), (6, 4, 3), (5, 3, 4), (4, 6, 2)])
def test_all_filters(shape):
    rng = np.random.default_rng(2)
    samples = rng.integers(0, 256, shape).astype(np.uint8)
    lines, step = filtered(samples, [k % 5 for k in range(shape[0])][::-1])
    assert (media.unfilter(lines, step) == samples.reshape(shape[0], -1)).all()
    assert (media.decode(media.encode(samples)) == samples).all()


def test_damage_is_seen():
    good = media.encode(np.arange(40, dtype=np.uint8).reshape(5, 8))
    for at in (0, 20, 45, len(good) - 3):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(media.BadImage):
            media.decode(bytes(bad))
    for bad in (good[:-5], b"", good[:8], good.replace(b"IHDR", b"IHDX")):
        with pytest.raises(media.BadImage):
            media.decode(bad)
    body = zlib.compress(b"\x09" + bytes(8))
    odd = media.SIGNATURE + media._chunk(b"IHDR", struct.pack(">IIBBBBB", 8, 1, 8, 0, 0, 0, 0)) + media._chunk(b"IDAT", body) + media._chunk(b"IEND", b"")
    with pytest.raises(media.BadImage):
        media.decode(odd)


def test_hash():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 256, (40, 576)).astype(np.uint8)
    a = media.cosine_hash(x)
    assert len(a) == 16 and a == media.cosine_hash(x.copy())
    near = media.cosine_hash(np.clip(x.astype(int) + 2, 0, 255).astype(np.uint8))
    far = media.cosine_hash(rng.integers(0, 256, (40, 576)).astype(np.uint8))
    bits = lambda p, q: bin(int(p, 16) ^ int(q, 16)).count("1")
    assert bits(a, near) <= 6 < bits(a, far)


def test_round_trip(table, prose):
    rows = prose + [(900, "y" * 576), (901, "y" * 577), (902, "é" * 60000)]
    out = {r.doc_id: r for r in media.read(media.store(table(rows))).collect()}
    for key, text in rows:
        raw = (text or "").encode()
        want = raw.ljust(max(1, -(-len(raw) // 576)) * 576, b"\xff")
        assert bytes(out[key].payload) == want and out[key].n_bytes == len(raw)
    same = [k for k, t in rows if t == rows[-4][1]]
    assert len({(bytes(out[k].media), out[k].feature) for k in same}) == 1


def test_edge_cases(spark, table):
    assert media.read(media.store(table([]))).collect() == []
    odd = table([(1, None), (1, None)]).selectExpr("*", "1 as media", "2 as payload")
    rows = media.read(media.store(odd)).collect()
    assert len(rows) == 2 and rows[0] == rows[1] and bytes(rows[0].payload) == b"\xff" * 576
    from cytoplan.llm.queries import op4_media

    r = op4_media(spark, "/root/testdata/sf0.001").orderBy("doc_id").first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter(f"doc_id = {r.doc_id}").first().text.encode()
    want = text.ljust(max(1, -(-len(text) // 576)) * 576, b"\xff")
    assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
