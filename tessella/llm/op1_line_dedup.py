"""Line dedup: an exact set-similarity join of lines, later matches removed.

A line's set are its distinct words (A-Z lower-cased). Words are ordered by
rarity: words outside the ``VOCABULARY`` most frequent first, by hash, then
those by rising frequency. Two sets of a Jaccard similarity of at least
``PERCENT`` % share a word of their prefixes of ``n - ceil(t n) + 1`` words;
joining on prefix words, with length, positional and 64-bit parity filters,
then verifying the sets, finds them all. Words of over ``CROWDED`` lines are
joined on in pairs only (see ``keys``), so that no word makes a bucket that
grows with the corpus. Equal sets are one class before.

A line goes if an equal or similar line occurs earlier (by doc_id, then line
number), kept or not; so the result does not depend on any order of work,
and one match that is early enough settles a line. First each class is
measured against its neighbours in its buckets, in an order by hash, and
the nearest by parity are verified; only lines still without an earlier match
meet the others, and only earlier ones.

The index of prefix words travels and is stored in packed parts (a part has
all rows of its words), which are sorted and joined in arrays; Spark sees a
part, not its rows. A task holds one part: 2**19 words of lines give a part,
and a word of more lines than that adds its own rows.

Cases: null text has no line; an empty text has one, empty; lines without a
word are never matched; under ``SMALL`` words only equal sets are similar;
rows with one doc_id are ordered by the text's crc, and identical rows are
the same lines twice: the first of them (in any order) counts as earlier for
none, both lose the same lines; null doc_ids come last; extra columns are
ignored; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .staging import Bucketed, Staged, bounded, partitions, release, small

PERCENT = 85
SMALL = -(-PERCENT // (100 - PERCENT))  # the least set that can have another as its match
VOCABULARY = 1 << 18
CROWDED = 1 << 12  # lines of a word that is taken in pairs only: there, comparing costs more than the pairs
LONG = 256  # words of a line whose crowded words are not paired
WIDE = 4  # words of the sketch of classes that have a near neighbour
ROUNDS = 2
KEYS = 8
FLUSH = 1 << 20
PACKED = 1 << 18  # rows of the index, or pairs, that a task handles at once
PART_WORDS = 1 << 19  # words of lines (with repeats) for which there is a part of the index
TOPS = 21  # bits
LAST = (1 << 63) - 1

_U = np.uint64
_ODD = [f"o{i}" for i in range(WIDE)]


def lines(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line offsets, first line of each text) of a slice; every text has a line."""
    cut = np.flatnonzero(buf == 10) + 1
    at = np.sort(np.concatenate([off[:-1], cut]), kind="stable")
    per = np.diff(np.concatenate([[0], np.searchsorted(cut - 1, off[1:], side="left")])) + 1
    return np.append(at, len(buf)), np.concatenate([[0], np.cumsum(per)])


def word_sets(buf: np.ndarray, loff: np.ndarray, rank: K.HashMap | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places in the order of rarity, bounds): each line's distinct words, sorted."""
    low = K.lowered(buf)
    starts, ends, first = K.words(low, loff, gap=K.separators(low))
    x = (K.word_hashes(low, starts, ends) >> _U(1)) | _U(1)  # never 0
    if rank is not None:
        x = rank.replace(x)
    for s, e in zip(first[:-1].tolist(), first[1:].tolist()):
        if e - s > 1:
            x[s:e].sort()
    keep = np.ones(len(x), bool)
    keep[1:] = x[1:] != x[:-1]
    keep[first[:-1][np.diff(first) > 0]] = True
    return x[keep], np.concatenate([[0], np.cumsum(keep)])[first]


def class_ids(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, _U), np.cumsum(K.mix(x ^ _U(0x7F4A7C159E3779B9)), dtype=_U)])
    return K.signed(K.mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(_U)) >> _U(1))


_SCAN = "lid long, n int, doc_id long, crc long, line int, part int, words binary, seen binary"
_NAMES = [c.split()[0] for c in _SCAN.split(", ")]


def _packed(words: np.ndarray, counts: np.ndarray, parts: int) -> tuple[list[int], list[bytes], list[bytes]]:
    """Sorted words and counts cut into ranges of the words, one row each."""
    cut = np.searchsorted(words, (np.arange(parts + 1) * ((1 << 63) // parts)).astype(_U))
    cut[-1] = len(words)
    rows = [(p, words[lo:hi].tobytes(), counts[lo:hi].astype("<u4").tobytes()) for p, (lo, hi) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if hi > lo]
    return tuple(map(list, zip(*rows))) if rows else ([], [], [])


def _scan(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per line with words; and per task and range of words, their numbers of lines."""
        waiting: list[np.ndarray] = []

        def counted():
            x = np.sort(np.concatenate(waiting))
            at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)
            part, words, seen = _packed(x[at], np.diff(np.append(at, len(x))), parts)
            none = [pa.nulls(len(part), t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32())]
            return pa.RecordBatch.from_arrays([*none, pa.array(part, pa.int32()), pa.array(words, pa.binary()), pa.array(seen, pa.binary())], _NAMES)

        for batch in batches:
            for lo, hi, buf, off in K.slices(batch.column(1)):
                loff, first = lines(buf, off)
                x, bounds = word_sets(buf, loff)
                n = np.diff(bounds)
                waiting.append(x)
                real = np.flatnonzero(n)
                doc = np.searchsorted(first, real, side="right") - 1
                crc = np.array([zlib.crc32(buf[s:e]) for s, e in zip(off[:-1].tolist(), off[1:].tolist())], np.int64)
                ids = batch.column(0).slice(lo, hi - lo).fill_null(LAST).to_numpy()
                none = pa.nulls(len(real), pa.int32()), pa.nulls(len(real), pa.binary()), pa.nulls(len(real), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(class_ids(x, bounds)[real]), pa.array(n[real].astype(np.int32)), pa.array(ids[doc]), pa.array(crc[doc]), pa.array((real - first[doc]).astype(np.int32)), *none], _NAMES)
                if sum(map(len, waiting)) > FLUSH:
                    yield counted()
                    waiting = []
        if waiting:
            yield counted()

    return run


def _sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the packed counts; all rows of a range are in one task. Words of over three lines go on."""
    words: dict[int, list] = {}

    def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
        w, c = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        by = np.argsort(w, kind="stable")
        w, c = w[by], c[by]
        at = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])) if len(w) else np.empty(0, np.int64)
        return w[at], np.add.reduceat(c, at) if len(at) else c

    for batch in batches:
        for part, w, c in zip(*(batch.column(i) for i in range(3))):
            have = words.setdefault(part.as_py(), [])
            have.append((np.frombuffer(w.as_buffer(), _U), np.frombuffer(c.as_buffer(), "<u4").astype(np.int64)))
            if len(have) > 16:
                words[part.as_py()] = [merged(have)]
    for have in words.values():
        w, c = merged(have)
        yield pa.RecordBatch.from_arrays([pa.array(K.signed(w[c > 3])), pa.array(c[c > 3])], ["word", "seen"])


def parity(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    bit = _U(1) << (K.mix(x ^ _U(0x2545F4914F6CDD1D)) >> _U(58))
    run = np.concatenate([np.zeros(1, _U), np.bitwise_xor.accumulate(bit)]) if len(bit) else np.zeros(1, _U)
    return run[bounds[1:]] ^ run[bounds[:-1]]


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - (PERCENT * n + 99) // 100 + 1


def keys(x: np.ndarray, bounds: np.ndarray, crowded: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, set, place in it) of the words that sets are joined on; words from ``crowded`` on only in pairs.

    A set without a crowded word in its prefix has a common word there with any
    similar set, a key of both. Two others have two common words in prefixes
    that are longer by one: one of them is not crowded, or the pair is a key of
    both. Long sets take crowded words singly, apart from other sets; sets that
    can be similar to long and to other sets do both.
    """
    n = np.diff(bounds)
    size, low = prefix_length(n), bounds[:-1]
    late = np.concatenate([[0], np.cumsum(x >= _U(crowded))])
    tail = late[low + size] - late[low]
    size = size + (tail > 0)
    tail = late[low + size] - late[low]
    single, owner = K.runs(low, low + size - tail)
    found = [(x[single], owner, single - low[owner])]
    which = np.flatnonzero((tail > 0) & (100 * n >= PERCENT * LONG))
    at, owner = K.runs((low + size - tail)[which], (low + size)[which])
    found.append((K.mix(x[at] ^ _U(0x6A09E667F3BCC909)), which[owner], at - low[which[owner]]))
    for c in np.unique(tail[(tail > 1) & (n <= LONG)]).tolist():
        which = np.flatnonzero((tail == c) & (n <= LONG))
        i, j = np.triu_indices(c, 1)
        first = (low + size - c)[which][:, None]
        key = K.mix(K.mix(x[first + i]) + x[first + j])
        found.append((key.ravel(), np.repeat(which, len(i)), (first + i - low[which][:, None]).ravel()))
    return tuple(np.concatenate(z) for z in zip(*found))


_INDEX = ["<u8", "<i8", "<i8", "<u8", "<i4", "<i4"]  # key, lid, doc_id, parity, n, place
_WIDTH = sum(np.dtype(t).itemsize for t in _INDEX)


def pack(cols: list[np.ndarray]) -> bytes:
    return b"".join(c.astype(t, copy=False).tobytes() for c, t in zip(cols, _INDEX))


def unpack(blob) -> list[np.ndarray]:
    rows, at, out = len(blob) // _WIDTH, 0, []
    for t in _INDEX:
        out.append(np.frombuffer(blob, t, rows, at))
        at += rows * np.dtype(t).itemsize
    return out


def _unpacked(column: pa.ChunkedArray) -> list[np.ndarray]:
    found = [unpack(x.as_buffer()) for x in column]
    return [np.concatenate(c) for c in zip(*found)] if found else unpack(b"")


def _prefixes(rank, crowded: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of the index, packed by part."""
        order, names = K.HashMap(*rank.value), class_names(rank.value)
        seen: set[int] = set()
        waiting: list[tuple] = []

        def dealt():
            cols = [np.concatenate(c) for c in zip(*waiting)]
            part = (K.mix(cols[0]) % _U(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)
            by = np.argsort(part, kind="stable")
            cols, part = [c[by] for c in cols], part[by]
            cut = np.append(np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), len(part)) if len(part) else np.zeros(1, np.int64)
            blobs = [pack([c[lo:hi] for c in cols]) for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist())]
            return pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())], ["part", "rows"])

        for batch in batches:
            for lo, hi, buf, off in K.slices(batch.column(1)):
                loff, first = lines(buf, off)
                x, bounds = word_sets(buf, loff, order)
                n = np.diff(bounds)
                lid = class_ids(named(x, names), bounds)
                if len(seen) > FLUSH:
                    seen.clear()
                take = np.flatnonzero((n >= SMALL) & np.array([not (v in seen or seen.add(v)) for v in lid.tolist()], bool))
                inside, _ = K.runs(bounds[take], bounds[take + 1])
                key, who, place = keys(x[inside], np.concatenate([[0], np.cumsum(n[take])]), crowded)
                who = take[who]
                ids = batch.column(0).slice(lo, hi - lo).fill_null(LAST).to_numpy()
                doc = ids[np.searchsorted(first, np.arange(len(n)), side="right") - 1]
                waiting.append((key, lid[who], doc[who], parity(x, bounds)[who], n[who].astype("<i4"), place.astype("<i4")))
                if sum(len(w[0]) for w in waiting) > PACKED:
                    yield dealt()
                    waiting = []
        if waiting:
            yield dealt()

    return run


def _least(total: np.ndarray) -> np.ndarray:
    """Common words that similar sets of so many words together have at least."""
    return (total * PERCENT + 99 + PERCENT) // (100 + PERCENT)


def may(n, place, odd, n2, place2, odd2) -> np.ndarray:
    """Length, positional and parity filters of pairs of index rows (of one key each)."""
    total = n + n2
    least = _least(total)
    ok = (100 * np.minimum(n, n2) >= PERCENT * np.maximum(n, n2)) & (np.bitwise_count(odd ^ odd2) <= total - 2 * least)
    return ok & (np.minimum(place, place2) + np.minimum(n - place, n2 - place2) >= least)


_SORTED = "part int, rows binary, a long, far float, b long"


def _sorted(table: pa.Table) -> pa.Table:
    """A part's rows in order, without repeats and keys of one class; and per class its nearest neighbour in a bucket."""
    key, lid, doc, odd, n, place = cols = _unpacked(table.column("rows"))
    turn = key % _U(64)
    by = np.lexsort((doc, lid, (odd << turn) | (odd >> ((_U(64) - turn) % _U(64))), key))
    key, lid = key[by], lid[by]
    fresh = np.ones(len(by), bool)  # of a class that several tasks emit the first row stays
    fresh[1:] = (key[1:] != key[:-1]) | (lid[1:] != lid[:-1])
    by, key = by[fresh], key[fresh]
    same = np.zeros(len(by) + 1, bool)
    same[1:-1] = key[1:] == key[:-1]
    by = by[same[:-1] | same[1:]]
    key, lid, doc, odd, n, place = cols = [c[by] for c in cols]
    n, place = n.astype(np.int64), place.astype(np.int64)
    at = np.flatnonzero(key[1:] == key[:-1]) + 1
    at = at[may(n[at], place[at], odd[at], n[at - 1], place[at - 1], odd[at - 1])]
    far = (np.bitwise_count(odd[at] ^ odd[at - 1]) / (n[at] + n[at - 1])).astype(np.float32)
    by = np.lexsort((lid[at - 1], far, lid[at]))
    a, far, b = lid[at][by], far[by], lid[at - 1][by]
    one = np.ones(len(a), bool)
    one[1:] = a[1:] != a[:-1]
    a, far, b = a[one], far[one], b[one]
    rows = [pack(cols)] if len(key) else []
    full, none = len(rows), pa.nulls
    part = table.column("part")[0].as_py()
    return pa.table({
        "part": pa.array([part] * full + [None] * len(a), pa.int32()), "rows": pa.array(rows + [None] * len(a), pa.binary()), "a": pa.concat_arrays([none(full, pa.int64()), pa.array(a)]),
        "far": pa.concat_arrays([none(full, pa.float32()), pa.array(far)]), "b": pa.concat_arrays([none(full, pa.int64()), pa.array(b)]),
    })


def _members(tops):
    """The rows of classes whose first bits are among tops: of all that are wanted, and of some others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has = np.zeros(1 << TOPS, bool)
        has[tops.value] = True
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                key, lid = unpack(blob.as_buffer())[:2]
                ok = np.flatnonzero(has[lid >> (63 - TOPS)])
                for at in range(0, len(ok), PACKED):
                    own = ok[at : at + PACKED]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), part, np.int32)), pa.array(K.signed(key[own])), pa.array(lid[own])], ["part", "word", "lid"])

    return run


def _pieces(count: np.ndarray) -> Iterator[slice]:
    """Ranges of about PACKED of the counted."""
    total, lo = np.cumsum(count), 0
    while lo < len(count):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PACKED, side="right")))
        yield slice(lo, hi)
        lo = hi


def _pairs(table: pa.Table, known: pa.Table) -> pa.Table:
    """Classes a < b that share a key of the part and pass the filters, and are not both known (lid, done).

    A known class that is done has its earlier match, so it meets only classes that may be later.
    """
    key, lid, doc, odd, n, place = _unpacked(table.column("rows"))
    n, place = n.astype(np.int64), place.astype(np.int64)
    if not len(key):
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    have, at = np.unique(known.column("lid").to_numpy(), return_index=True)
    done = known.column("done").to_numpy()[at].astype(bool)
    at = np.minimum(np.searchsorted(have, lid), max(0, len(have) - 1))
    old = have[at] == lid if len(have) else np.zeros(len(lid), bool)
    settled = old & done[at] if len(have) else old
    bucket = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]) << 32
    new, old = (w[np.argsort(bucket[w] + n[w], kind="stable")] for w in (np.flatnonzero(~old), np.flatnonzero(old)))
    size, base = n[new], bucket[new]
    found = [np.empty((0, 2), np.int64)]
    for side in (new, old):
        order = bucket[side] + n[side]
        hi = np.searchsorted(order, base + 100 * size // PERCENT, side="right")
        lo = np.arange(1, len(new) + 1) if side is new else np.searchsorted(order, base - (-PERCENT * size // 100))
        own = [c[side] for c in (lid, doc, odd, n, place, settled)]
        for s in _pieces(hi - lo):
            j, i = K.runs(lo[s], hi[s])
            i = new[s][i]
            total = n[i] + own[3][j]
            ok = np.flatnonzero(np.bitwise_count(odd[i] ^ own[2][j]) <= total - 2 * _least(total))
            i, j = i[ok], j[ok]
            ok = may(n[i], place[i], odd[i], own[3][j], own[4][j], own[2][j]) & ((side is new) | (doc[i] >= own[1][j]) | ~own[5][j])
            i, j = lid[i[ok]], own[0][j[ok]]
            found.append(np.stack([np.minimum(i, j), np.maximum(i, j)], axis=1))
    pairs = np.unique(np.concatenate(found), axis=0)
    return pa.table({"a": pa.array(np.ascontiguousarray(pairs[:, 0])), "b": pa.array(np.ascontiguousarray(pairs[:, 1]))})


def class_names(rank) -> np.ndarray:
    """The frequent words' hashes by their place."""
    return rank[0][np.argsort(rank[1])]


def named(x: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The words' hashes again, of their places in the order (frequent ones are numbered from 2**63)."""
    late = x >> _U(63) > 0
    out = x.copy()
    out[late] = names[(x[late] ^ _U(1 << 63)).astype(np.int64)]
    return out


def wide_parity(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each set, WIDE words of 64 cells."""
    m = K.mix(x ^ _U(0x3C6EF372FE94F82B))
    bit, cell = _U(1) << (m >> _U(58)), m % _U(WIDE)
    out = np.empty((len(bounds) - 1, WIDE), _U)
    for c in range(WIDE):
        run = np.concatenate([np.zeros(1, _U), np.bitwise_xor.accumulate(np.where(cell == _U(c), bit, _U(0)))])
        out[:, c] = run[bounds[1:]] ^ run[bounds[:-1]]
    return out.view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The word sets, and their sketches, of the wanted (lid, line) of each text; other lines are not read into words."""
    for batch in batches:
        wanted = batch.column(1)
        for lo, hi, buf, off in K.slices(batch.column(0)):
            loff, first = lines(buf, off)
            own = wanted.slice(lo, hi - lo)
            each, asked = own.flatten(), np.repeat(np.arange(hi - lo), own.value_lengths().fill_null(0).to_numpy())
            lid, at = each.field(0).to_numpy(), first[asked] + each.field(1).to_numpy()
            there = at < first[asked + 1]
            lid, at, asked = lid[there], at[there], asked[there]
            inside, _ = K.runs(loff[at], loff[at + 1])
            x, bounds = word_sets(buf[inside], np.concatenate([[0], np.cumsum(loff[at + 1] - loff[at])]))
            ok = np.flatnonzero(class_ids(x, bounds) == lid)
            odd = wide_parity(x, bounds)[ok]
            items = [x[s:e].tobytes() for s, e in zip(bounds[ok].tolist(), bounds[ok + 1].tolist())]
            where = [batch.column(i).slice(lo, hi - lo).take(pa.array(asked[ok])) for i in (2, 3)] + [pa.array((at - first[asked])[ok].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(lid[ok]), pa.array(items, pa.binary()), pa.array(np.diff(bounds)[ok].astype(np.int32)), *(pa.array(np.ascontiguousarray(odd[:, i])) for i in range(WIDE)), *where], ["lid", "items", "n", *_ODD, "doc_id", "crc", "line"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lid, x, y = (batch.column(i) for i in range(3))
        ok = []
        for s, t in zip(x, y):
            both = np.concatenate([np.frombuffer(s.as_buffer(), _U), np.frombuffer(t.as_buffer(), _U)])
            both.sort()
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            ok.append(100 * common >= PERCENT * (len(both) - common))
        yield pa.RecordBatch.from_arrays([lid.filter(pa.array(ok, pa.bool_()))], ["lid"])


def _made(docs: DataFrame, classes: Staged, lids: Staged) -> Bucketed:
    """lid, items, n, sketch, at (doc_id, crc, line) of the classes named in lids, dealt out by lid: joins move pairs, not sets."""
    reps = classes.df().join(small(lids), "lid", "left_semi").groupBy("doc_id", "crc").agg(F.collect_list(F.struct("lid", "line")).alias("wanted"))
    reps = Staged(reps, "reps")
    keyed = docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(LAST)))
    sets = keyed.join(small(reps, 96), ["doc_id", "crc"]).select("text", "wanted", "doc_id", "crc").mapInArrow(_sets, f"lid long, items binary, n int, {', '.join(f'{x} long' for x in _ODD)}, doc_id long, crc long, line int").dropDuplicates(["lid"])
    made = Bucketed(sets.select("lid", "items", "n", *_ODD, F.struct("doc_id", "crc", "line").alias("at")), "sets", "lid")
    reps.drop()
    return made


def _late(pairs: DataFrame, made: Bucketed) -> Staged:
    """Classes (lid) that pairs (a, b) show to be similar to an earlier class."""
    x, y = (made.df().select(F.col("lid").alias(k), F.col("items").alias(f"items_{k}"), F.col("at").alias(f"at_{k}")) for k in "ab")
    both = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(x, "a").join(y, "b")
    both = both.select(F.when(F.col("at_a") < F.col("at_b"), F.col("b")).otherwise(F.col("a")).alias("lid"), "items_a", "items_b")
    return Staged(both.mapInArrow(_verify, "lid long").distinct(), "late")


def _alike(a: str, b: str) -> str:
    """SQL: lengths and wide sketches of a and b allow a match."""
    least = f"(({a}.n + {b}.n) * {PERCENT} + {99 + PERCENT}) div {100 + PERCENT}"
    return f"100 * least({a}.n, {b}.n) >= {PERCENT} * greatest({a}.n, {b}.n) and {_far(a, b)} <= {a}.n + {b}.n - 2 * ({least})"


def _far(a: str, b: str) -> str:
    return " + ".join(f"bit_count({a}.{x} ^ {b}.{x})" for x in _ODD)


def _turned(sketch: str):
    """An order in which near sketches are neighbours where their first bits agree; other bits in other buckets."""
    return F.expr(f"shiftleft({sketch}, cast(pmod(word, 64) as int)) | shiftrightunsigned({sketch}, cast(64 - pmod(word, 64) as int))")


def _settled(state: Staged, late: Staged) -> Staged:
    """state (lid, done) with the late classes done."""
    out = Staged(state.df().join(small(late).withColumn("_late", F.lit(True)), "lid", "left").select("lid", (F.col("done") | F.col("_late").isNotNull()).alias("done")), "state")
    for t in (state, late):
        t.drop()
    return out


def _matched(docs: DataFrame, classes: Staged, rows: Staged) -> tuple[Staged, Staged]:
    """(lid, done) of the classes that have a near neighbour in a bucket, and (part, word, lid) of their index rows.

    These meet each other here: over a few rounds the nearest of their
    neighbours, by a wide sketch, is verified; then those that have no earlier
    match yet meet all earlier ones of their buckets.
    """
    near = Staged(rows.df().where("a is not null").groupBy("a").agg(F.min(F.struct("far", "b")).alias("m")).select("a", F.col("m.b").alias("b")), "near")
    close = Staged(near.df().select(F.col("a").alias("lid")).unionByName(near.df().select(F.col("b").alias("lid"))).distinct(), "close")
    made = _made(docs, classes, close)
    state = _settled(Staged(close.df().withColumn("done", F.lit(False)), "state"), _late(near.df(), made))
    tops = close.df().select(F.shiftright("lid", 63 - TOPS).cast("int").alias("top")).distinct().toPandas()["top"].to_numpy(np.int32)  # at most 2 ** TOPS
    tops = docs.sparkSession.sparkContext.broadcast(tops)
    members = rows.df().where("rows is not null").select("part", "rows").mapInArrow(_members(tops), "part int, word long, lid long")
    members = Staged(members.join(small(close), "lid", "left_semi").select("part", "word", "lid"), "members")
    facts = Staged(made.df().select("lid", "n", "at", *_ODD), "facts")
    for turn in range(ROUNDS):
        known = small(facts, 128).join(small(state), "lid")
        by = Window.partitionBy("word").orderBy(_turned(_ODD[turn]), "lid")
        met = members.df().join(small(facts, 128), "lid").select(F.col("lid").alias("a"), F.lag("lid").over(by).alias("b")).where("a <> b").distinct()
        met = met.alias("p").join(known.alias("x"), F.expr("p.a = x.lid")).join(known.alias("y"), F.expr("p.b = y.lid")).where(_alike("x", "y"))
        met = met.where("not (case when x.at < y.at then y.done else x.done end)")
        met = met.select("p.a", "p.b", F.expr(f"({_far('x', 'y')}) / (x.n + y.n)").alias("far")).groupBy("a").agg(F.min(F.struct("far", "b")).alias("m"))
        state = _settled(state, _late(met.select("a", "m.b"), made))
    first = members.df().groupBy("lid").agg(F.collect_set("word").alias("k")).select("lid", F.slice(F.array_sort("k"), 1, KEYS).alias("k"))
    first = Staged(first, "first")
    known = members.df().join(small(facts, 128), "lid").join(small(state), "lid").join(small(first, 128), "lid")
    # a pair that has common ones among its first keys is made at the least of those only
    once = "coalesce(x.word = array_min(array_intersect(x.k, y.k)), true)"
    both = known.alias("x").join(known.alias("y"), F.expr(f"x.word = y.word and not x.done and x.at > y.at and {_alike('x', 'y')} and {once}"))
    state = _settled(state, _late(both.select(F.col("x.lid").alias("a"), F.col("y.lid").alias("b")), made))
    for t in (near, close, made, facts, first):
        t.drop()
    return state, members


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, gone, near in zip(*(batch.column(i) for i in (1, 2, 3))):
            kept, drop = text.as_buffer().to_pybytes() if text.is_valid else b"", set(gone.as_py() or ())
            total = kept.count(b"\n") + 1 if text.is_valid else 0
            if drop:
                kept = b"\n".join(x for i, x in enumerate(kept.split(b"\n")) if i not in drop)
            rows.append((total, len(drop), near.as_py() or 0, hashlib.sha256(kept).hexdigest(), kept.decode()))
        n, g, s, d, k = list(zip(*rows)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(g, pa.int64()), pa.array(s, pa.int64()), pa.array(d, pa.string()), pa.array(k, pa.string())], ["doc_id", "n_lines", "n_removed", "n_near", "kept_sha256", "kept_text"])


def remove_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed (n_near: by a similar, not an equal line), kept_sha256, kept_text of docs (doc_id, text)."""
    spark = bounded(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = docs.withColumn("crc", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    parts = partitions(spark)
    scan = Staged(docs.mapInArrow(_scan(parts), _SCAN), "scan")
    where = scan.df().where("lid is not null").select("lid", "n", "doc_id", "crc", "line")
    first = where.groupBy("lid").agg(F.min(F.struct("doc_id", "crc", "line")).alias("at"))
    classes = Staged(first.select("lid", "at.doc_id", "at.crc", "at.line"), "classes")

    packed = scan.df().where("part is not null").select("part", "words", "seen").repartition(parts, "part")
    seen = Staged(packed.mapInArrow(_sum_counts, "word long, seen long"), "words")
    steps = sorted(((r.seen, r["count"]) for r in seen.df().groupBy("seen").count().collect()), reverse=True)  # one row per distinct frequency
    least, room = LAST, VOCABULARY
    for f, n in steps:
        room -= n
        if room < 0:
            break
        least = f
    top = seen.df().where(F.col("seen") >= least).toPandas()  # at most VOCABULARY rows
    word, freq = top["word"].to_numpy(np.int64).view(_U), top["seen"].to_numpy(np.int64)
    by = np.lexsort((word, freq))
    place = np.empty(len(word), _U)
    place[by] = _U(1 << 63) + np.arange(len(word)).astype(_U)
    crowded = (1 << 63) + int(np.count_nonzero(freq <= CROWDED))  # the place of the first crowded word
    by = np.argsort(word)
    rank = spark.sparkContext.broadcast((word[by], place[by]))

    total = scan.df().agg(F.sum("n")).first()[0] or 0
    cut = max(4 * parts, total // PART_WORDS)
    rows = docs.mapInArrow(_prefixes(rank, crowded, cut), "part int, rows binary")
    rows = Staged(rows.groupBy("part").applyInArrow(_sorted, _SORTED), "prefixes")
    release(spark)
    state, members = _matched(keyed, classes, rows)
    release(spark)

    # the pairs that are not both among those
    known = members.df().select("part", "lid").join(small(state), "lid").select("part", "lid", "done")
    index = rows.df().where("rows is not null").select("part", "rows")
    pairs = Staged(index.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(_pairs, "a long, b long").distinct(), "pairs")
    members.drop()
    met = Staged(pairs.df().select(F.col("a").alias("lid")).unionByName(pairs.df().select(F.col("b").alias("lid"))).distinct(), "met")
    made = _made(keyed, classes, met)
    known = made.df().select("lid", "n", *_ODD)
    alike = pairs.df().alias("p").join(known.alias("x"), F.expr("p.a = x.lid")).join(known.alias("y"), F.expr("p.b = y.lid")).where(_alike("x", "y")).select("p.a", "p.b")
    late, more = Staged(state.df().where("done").select("lid"), "late"), _late(alike, made)
    for t in (rows, state, pairs, met, made):
        t.drop()

    late_all = late.df().unionByName(more.df()).distinct().withColumn("near", F.lit(1))
    at = classes.df().select("lid", F.struct("doc_id", "crc", "line").alias("at")).join(late_all, "lid", "left")
    gone = where.join(at, "lid").where(F.col("near").isNotNull() | (F.struct("doc_id", "crc", "line") != F.col("at")))
    gone = gone.select("doc_id", "crc", "line", F.when(F.struct("doc_id", "crc", "line") == F.col("at"), 1).otherwise(0).alias("near")).distinct()
    gone = Staged(gone.groupBy("doc_id", "crc").agg(F.collect_list("line").alias("gone"), F.sum("near").alias("near")), "gone")
    side = small(gone, 96).withColumnRenamed("doc_id", "_i")
    out = keyed.join(side, (F.coalesce("doc_id", F.lit(LAST)) == F.col("_i")) & (keyed["crc"] == side["crc"]), "left").select("doc_id", "text", "gone", "near")
    for t in (scan, seen, late, more):
        t.drop()
    release(spark)
    return out.mapInArrow(_cut, "doc_id long, n_lines long, n_removed long, n_near long, kept_sha256 string, kept_text string")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept_text")


QUERIES = {"op1_line_dedup": op1_line_dedup}
ORACLE = {
    "op1_line_dedup": r"""
with t as (select doc_id, str_split(text, chr(10)) as ls from documents where text is not null),
l as (select doc_id, unnest(range(1, len(ls) + 1)) as k, ls from t),
s as (select doc_id, k, list_sort(list_distinct(regexp_extract_all(translate(ls[k], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'))) as w from l),
c as (select w, min(doc_id * 1000000 + k) as pos from s where len(w) > 0 group by w),
i as (select pos, len(w) as n, unnest(w) as x from c where len(w) > 5),
f as (select x, count(*) as df from i group by x),
r as (select i.pos, i.n, i.x, row_number() over (partition by pos order by df, i.x) as p from i join f on i.x = f.x),
q as (select * from r where p <= n - (85 * n + 99) // 100 + 1),
d as (select distinct a.pos as a, b.pos as b, a.n as n, b.n as m from q a join q b on a.x = b.x and a.pos < b.pos and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
v as (select d.b from d join c x on x.pos = d.a join c y on y.pos = d.b where 100 * len(list_intersect(x.w, y.w)) >= 85 * (n + m - len(list_intersect(x.w, y.w)))),
g as (select s.doc_id, s.k, case when c.pos = s.doc_id * 1000000 + s.k then 1 else 0 end as near from s join c on s.w = c.w where c.pos <> s.doc_id * 1000000 + s.k or c.pos in (select b from v)),
o as (select doc_id, list(k) as gone, sum(near) as near from g group by doc_id)
select d.doc_id, coalesce(len(ls), 0) as n_lines, coalesce(len(gone), 0) as n_removed, coalesce(near, 0)::bigint as n_near,
  sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda p: not list_contains(coalesce(gone, []), p)), lambda p: ls[p]), chr(10)), '')) as kept_sha256
from documents d left join t on t.doc_id = d.doc_id left join o on o.doc_id = d.doc_id
""",
}
