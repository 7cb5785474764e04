import hashlib
import random
import re
import zlib

import numpy as np

from tessella.llm import op1_line_dedup as L
from tessella.llm import staging

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute(docs):
    found = {}
    for i, t in docs:
        for k, x in enumerate(t.split("\n") if t is not None else []):
            s = frozenset(WORD.findall(low(x)))
            if s:
                at = (L.LAST if i is None else i, zlib.crc32(t.encode()), k)
                found[s] = min(at, found.get(s, at))
    late = {s for s in found for z in found if found[z] < found[s] and 100 * len(s & z) >= L.PERCENT * len(s | z)}
    out = []
    for i, t in docs:
        kept, near, own = [], 0, t.split("\n") if t is not None else []
        for k, x in enumerate(own):
            s = frozenset(WORD.findall(low(x)))
            first = s and found[s] == (L.LAST if i is None else i, zlib.crc32(t.encode()), k)
            if s and (not first or s in late):
                near += bool(first)
            else:
                kept.append(x)
        out.append((i, len(own), len(own) - len(kept), near, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    v = ["the", "of", "é"] * 30 + [f"w{i}" for i in range(250)]
    base = [r.choices(v, k=r.choice([1, 2, 5, 6, 8, 14, 30, 60])) for _ in range(40)]
    docs = [(0, None), (1, ""), (2, "\n\n"), (3, " \t\nA b\n\n a B \n"), (None, "A b\nlone line"), (None, "lone line")]
    for _ in range(90):
        text = []
        for _ in range(r.randrange(1, 6)):
            w = list(r.choice(base))
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                w[r.randrange(len(w))] = r.choice(v)
            r.shuffle(w)
            text.append(r.choice([" ", "  "]).join(w))
        docs.append((r.randrange(500), "\n".join(text) + r.choice(["", "\n"])))
    return docs + docs[-2:]


def run(spark, docs, parts=3):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n int, line string").repartition(parts)
    return sorted((tuple(r)[:5] for r in L.remove_lines(df).collect()), key=str)


def test_equals_brute_force(spark, monkeypatch):
    for seed in (1, 2):
        docs = corpus(seed)
        assert run(spark, docs) == brute(docs)
    monkeypatch.setattr(L, "CROWDED", 6)  # nearly all words in pairs
    assert run(spark, docs) == brute(docs)
    monkeypatch.setattr(L, "LONG", 16)
    assert run(spark, docs) == brute(docs)
    monkeypatch.setattr(L, "VOCABULARY", 3)
    monkeypatch.setattr(staging, "BROADCAST_BYTES", -1)
    assert run(spark, docs, 6) == brute(docs)


def test_lines_of_a_slice():
    texts = ["a\nb", "", "\n", "x\n", "y"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0, *map(len, texts)])
    loff, first = L.lines(raw, off)
    assert np.diff(first).tolist() == [len(t.split("\n")) for t in texts]
    got = [raw[s:e].tobytes().decode().rstrip("\n") for s, e in zip(loff[:-1], loff[1:])]
    assert got == [x for t in texts for x in t.split("\n")]


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, None)]) == [(None, 0, 0, 0, hashlib.sha256(b"").hexdigest())]


def test_hash_map():
    from tessella.llm import kernels as K

    r = np.random.default_rng(3)
    for n in (0, 1, 5000):
        keys = np.unique(r.integers(1, 1 << 62, n).astype(np.uint64))
        m = K.HashMap(keys, np.arange(len(keys)).astype(np.uint64))
        x = np.concatenate([keys, r.integers(1, 1 << 62, 1000).astype(np.uint64)])
        want = np.array([np.flatnonzero(keys == v)[0] if v in set(keys.tolist()) else v for v in x.tolist()], np.uint64) if n < 100 else None
        got = m.replace(x)
        assert (got[: len(keys)] == np.arange(len(keys))).all() and (got[len(keys) :] == x[len(keys) :]).all()
        assert want is None or (got == want).all()


def test_keys_meet_all_similar_sets():
    r = random.Random(5)
    sets = []
    for _ in range(60):
        w = r.sample(range(100, 400), r.choice([6, 8, 13, 20, 27, 40]))
        sets.append(sorted(w))
        for _ in range(3):
            v = set(w)
            for _ in range(r.randrange(4)):
                v.discard(r.choice(w))
                v.add(r.randrange(100, 400))
            sets.append(sorted(v))
    x = np.concatenate([np.array(s, np.uint64) for s in sets])
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    for crowded in (0, 200, 300, 500):
        key, who, place = L.keys(x, bounds, crowded)
        own = [set() for _ in sets]
        for k, w in zip(key.tolist(), who.tolist()):
            own[w].add(k)
        for i, a in enumerate(sets):
            for j in range(i):
                b, n = sets[j], len(set(a) & set(sets[j]))
                if 100 * n >= L.PERCENT * (len(a) + len(b) - n):
                    assert own[i] & own[j], (crowded, a, b)


def test_wanted_sets_do_not_cost_the_other_lines(monkeypatch):
    import pyarrow as pa

    texts = ["\n".join(f"w{i} of line number {k} here" for k in range(50)) for i in range(20)] + [None, ""]
    raw = [x.encode() for x in texts if x]
    buf, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    loff, first = L.lines(buf, off)
    x, bounds = L.word_sets(buf, loff)
    lid = L.class_ids(x, bounds)
    wanted = [[] for _ in texts]
    wanted[3] = [{"lid": int(lid[first[3] + 7]), "line": 7}, {"lid": 5, "line": 8}, {"lid": 5, "line": 50}]
    wanted[9] = [{"lid": int(lid[first[9]]), "line": 0}]
    read, plain = [], L.word_sets
    monkeypatch.setattr(L, "word_sets", lambda b, *a: read.append(len(b)) or plain(b, *a))
    kind = pa.list_(pa.struct([("lid", pa.int64()), ("line", pa.int32())]))

    def batch(texts, wanted, ids):
        return pa.RecordBatch.from_arrays([pa.array(texts), pa.array(wanted, kind), pa.array(ids), pa.array(ids)], ["text", "wanted", "doc_id", "crc"])

    for rows in (batch(texts, wanted, range(len(texts))), batch(["x", *texts], [[], *wanted], range(-1, len(texts))).slice(1)):
        got = {r["lid"]: r for b in L._sets(iter([rows])) for r in b.to_pylist()}
        assert set(got) == {int(lid[first[3] + 7]), int(lid[first[9]])}
        for at in (first[3] + 7, first[9]):
            own = x[bounds[at] : bounds[at + 1]]
            assert (got[int(lid[at])]["doc_id"], got[int(lid[at])]["line"]) == ((3, 7) if at > first[3] and at < first[4] else (9, 0))
            assert got[int(lid[at])]["items"] == own.tobytes() and got[int(lid[at])]["n"] == len(own)
    assert sum(read) < len(buf) // 10


def test_packed_index_gives_all_pairs(monkeypatch):
    import pyarrow as pa

    r = np.random.default_rng(7)
    n = 400
    lid, size = np.arange(1, n + 1), r.integers(6, 40, n)
    word, who = np.divmod(r.choice(30 * n, 3000, replace=False), n)
    rows = [word.astype(np.uint64), lid[who], (lid * 7 % 90)[who], r.integers(0, 1 << 12, n).astype(np.uint64)[who], size[who], r.integers(0, 4, 3000)]
    again = [np.concatenate([c, c[:500]]) for c in rows]
    again[2][3000:] += 1  # another task's row of the class
    half = 1700
    blobs = [L.pack([c[:half] for c in again]), L.pack([c[half:] for c in again])]
    assert all((a == b).all() for a, b in zip(L.unpack(L.pack(again)), again))
    out = L._sorted(pa.table({"part": pa.array([4, 4], pa.int32()), "rows": pa.array(blobs, pa.binary())}))
    index = out.filter(out["rows"].is_valid()).select(["part", "rows"])
    own = L._unpacked(index["rows"])
    assert sorted(zip(*map(np.ndarray.tolist, own))) == sorted(zip(*map(np.ndarray.tolist, rows)))
    near = out.filter(out["a"].is_valid()).to_pylist()
    assert near and len({x["a"] for x in near}) == len(near)
    known = {int(v): bool(v % 2) for v in lid[::3]}
    want, whole = set(), list(zip(*map(np.ndarray.tolist, rows)))
    for x in whole:
        for y in whole:
            total = x[4] + y[4]
            least = -(-L.PERCENT * total // (100 + L.PERCENT))
            fits = 100 * min(x[4], y[4]) >= L.PERCENT * max(x[4], y[4]) and (x[3] ^ y[3]).bit_count() <= total - 2 * least and min(x[5], y[5]) + min(x[4] - x[5], y[4] - y[5]) >= least
            if x[0] == y[0] and x[1] != y[1] and x[2] >= y[2] and fits and (x[1] not in known or not known[x[1]] and y[1] not in known):
                want.add((min(x[1], y[1]), max(x[1], y[1])))
    marks = pa.table({"part": pa.array([4] * len(known), pa.int32()), "lid": pa.array(list(known)), "done": pa.array(list(known.values()))})
    for packed in (1 << 18, 3):
        monkeypatch.setattr(L, "PACKED", packed)
        got = L._pairs(index, marks)
        assert want and set(zip(got["a"].to_pylist(), got["b"].to_pylist())) == want and got.num_rows == len(want)
    assert L._pairs(index, marks.slice(0, 0)).num_rows >= len(want) and L._pairs(index.slice(0, 0), marks).num_rows == 0


def test_index_rows_travel_packed(spark):
    import pyarrow as pa

    texts = [" ".join(f"w{i * k % 97}" for i in range(1, 30)) for k in range(1, 60)]
    rank = spark.sparkContext.broadcast((np.array([5], np.uint64), np.array([1 << 63], np.uint64)))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    got = [r for b in L._prefixes(rank, (1 << 63) + 1, 4)(iter([batch])) for r in b.to_pylist()]
    assert sorted(r["part"] for r in got) == [0, 1, 2, 3] and sum(len(L.unpack(r["rows"])[0]) for r in got) > 100
    assert not set.intersection(*(set(L.unpack(r["rows"])[0].tolist()) for r in got[:2]))


def test_word_hashes():
    from tessella.llm import kernels as K

    r = random.Random(4)
    words = [bytes(r.randrange(33, 256) for _ in range(r.choice([1, 2, 7, 8, 9, 16, 17, 64, 65, 200]))) for _ in range(3000)]
    words += words[:300] + [b"a", b"a\0", b"a\0\0", b"\0"]
    buf, ends = np.frombuffer(b" ".join(words), np.uint8), np.cumsum([len(w) + 1 for w in words]) - 1
    found = {}
    for w, h in zip(words, K.word_hashes(buf, ends - np.array([*map(len, words)]), ends).tolist()):
        assert found.setdefault(w, h) == h
    assert len(set(found.values())) == len(found)
    every = np.arange(256, dtype=np.uint8)
    assert (K.lowered(every) == K.LOWER).all() and (K.separators(every) == K.IS_SEP).all()
