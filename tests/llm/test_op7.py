import hashlib
import random
import zlib

from tessella.llm import op7_transport_stream as M

SIZES = [64, 128, 64 * 3, 64 * 40, 176, 170, 169, 168, 184, 183, 182, 300, 32768, 32768 - 14, 32769, 40000, 8 * 32768 + 5, 20 * 32768]


def test_round_trip_of_every_stuffing():
    r = random.Random(1)
    for n in [*SIZES, *range(1, 600, 7)]:
        x = r.randbytes(n)
        m = M.mux(x)
        s = M.demux(m)
        assert s.payload == x and len(m) % 188 == 0 and (s.lost, s.bad, s.dropped) == (0, 0, 0)
        assert s.streams == {0x100: 6} and s.programs == {1: 0x1000}
        assert s.pts == [i * 3600 for i in range(s.pes)] and len(s.access) == -(-s.pes // 8)


def test_known_values():
    # the CRC of a section with its own CRC is 0, and the check value of CRC-32/MPEG-2
    assert M.crc_mpeg(b"123456789") == 0x0376E6E7
    assert M._pts((1 << 33) - 1) == bytes([0x2F, 0xFF, 0xFF, 0xFF, 0xFF])
    assert M.mux(b"")[:4] == bytes([0x47, 0x40, 0x00, 0x10])


def test_damage_is_counted():
    x = random.Random(2).randbytes(3 * 32768)
    m = M.mux(x)
    cut = m[: 188 * 50] + m[188 * 51 :]
    s = M.demux(cut)
    assert s.lost == 1 and s.dropped == 1 and s.payload == x[32768:]
    twice = m[: 188 * 51] + m[188 * 50 :]
    assert M.demux(twice).payload == x and M.demux(twice).lost == 0
    bad = bytearray(m)
    bad[188 * 60] = 0
    assert M.demux(bytes(bad)).bad == 1
    bad = bytearray(m)
    bad[10] ^= 1
    assert M.demux(bytes(bad)).streams == {} and M.demux(bytes(bad)).bad == 1
    assert M.demux(b"").payload == b""


def test_query_columns(spark):
    docs = [(1, None), (2, ""), (3, "é" * 32), (3, "é" * 32), (None, "x" * 64), (5, "y" * 65), (6, "z" * 200_000)]
    df = spark.createDataFrame([(i, t, b"1") for i, t in docs], "doc_id long, text string, media binary").repartition(2)
    out = M.read_streams(M.store_streams(df).df()).collect()
    assert len(out) == 7
    by = {(r.doc_id, r.n_bytes): r for r in out}
    for i, t in docs:
        raw = (t or "").encode()
        p = raw + bytes({0: 64}.get(len(raw), -len(raw) % 64))
        r = by[i, len(raw)]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(M.mux(p)), hashlib.sha256(M.mux(p)).hexdigest())
    assert by[6, 200000].access_pts == [0] and "pes=7;rap=1;" in by[6, 200000].feature
    assert M.read_streams(M.store_streams(df.limit(0)).df()).collect() == []
