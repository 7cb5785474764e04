"""Token-ID / binary output: ids in canonical length-limited Huffman blocks.

1. Every text is tokenised once; ids go to a staged table, dealt out by
   ranges of doc_id and sorted, with running offsets.
2. Global counts of the ids (a sum of per-task counts, bounded by the
   vocabulary) give code lengths of at most ``MAX_BITS`` by package-merge;
   the canonical code follows from the lengths alone.
3. Blocks of whole documents are packed independently. A block is
   ``magic, n_docs, n_ids, n_checkpoints, directory, checkpoints, payload``;
   the checkpoints hold the bit offset of every ``STRIDE``-th id.
4. Decoding is table-driven, all stretches between checkpoints of many
   blocks at once, and needs only the block and the code lengths.

The files are a Parquet table ``blocks`` (one block per row, with the range
of the ids in it) and ``book`` (the code lengths), written by Spark's commit
protocol, so that a lost executor never leaves half a file.

The tokenizer splits texts into pieces and encodes each piece by itself.
Texts of ASCII and Latin letters are split here, on whole buffers, and each
distinct piece is encoded once per worker (a bounded table of pieces by their
64-bit hash); any other text, and any that holds a special token, goes to the
tokenizer whole. Ids are equal.

Cases: null counts as an empty text, whose only id is the end id; repeated
rows and equal doc_ids keep all their rows, ordered by their ids; null
doc_ids come first; extra columns are ignored; an empty table gives no
blocks and an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .staging import Staged, bounded, new_path, partitions, release

END_ID = 2
MAX_BITS = 16
STRIDE = 256
BLOCK_IDS = 1 << 17
PIECES_KEPT = 1 << 19  # of a worker's memory of encoded pieces (about 20 MB when full)
MAGIC = b"TSH1"

_U = np.uint64
_loaded: dict[str, PieceEncoder] = {}

# Classes of bytes: white space, letters (with all bytes of U+00C0..U+023F), digits, others; texts with further bytes are not split here.
_SPACE, _LETTER, _DIGIT, _OTHER, _FOREIGN = range(5)
_CLASS = np.full(256, _FOREIGN, np.uint8)
_CLASS[33:127] = _OTHER
_CLASS[[9, 10, 13, 32]] = _SPACE
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[0x80:0xC0] = _CLASS[0xC3:0xC9] = _LETTER


def split_pieces(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte of each piece, whether each text may be split so).

    Pieces are runs of letters, digits or other characters, with one space
    before; the contractions 's 't 'm 'd 're 've 'll where an apostrophe
    begins a piece; and white space, whose last character before a word
    stands alone unless it is a space, which goes to the word.
    """
    n = len(buf)
    kind = _CLASS[buf]
    bad = kind == _FOREIGN
    bad[:-1] |= (buf[:-1] == 0xC3) & ((buf[1:] == 0x97) | (buf[1:] == 0xB7))  # the signs of multiplication and division
    plain = np.diff(np.concatenate([[0], np.cumsum(bad)])[off]) == 0
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    space = kind == _SPACE
    before = np.zeros(n, bool)  # white space right before, in the text
    before[1:] = space[:-1] & ~edge[1:n]
    word_next = np.zeros(n, bool)
    word_next[:-1] = ~space[1:] & ~edge[1:n]
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    blank = np.zeros(n, bool)
    blank[1:] = buf[:-1] == 0x20
    start = edge[:n] | np.where(space, ~before | word_next, np.where(before, ~blank, change))
    q = np.flatnonzero((buf == 0x27) & start)
    q = q[q + 1 < n]
    q = q[~edge[q + 1]]
    if len(q):
        one = buf[q + 1]
        two = np.where(q + 2 < n, buf[np.minimum(q + 2, n - 1)], 0)
        two[edge[np.minimum(q + 2, n)]] = 0
        k = np.where(np.isin(one, list(b"stmd")), 1, np.where(((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C), 2, 0))
        q, k = q[k > 0], k[k > 0]
        start[q + 1] = False
        after = q + 1 + k
        go = after[(after < n) & ~edge[np.minimum(after, n)]]
        start[go[kind[go] == _LETTER]] = True
    return np.flatnonzero(start), plain


class PieceTable:
    """Ids of pieces by the 64-bit hash of their bytes, in flat arrays: open addressing, at most ``PIECES_KEPT``."""

    def __init__(self, dtype: np.dtype):
        self.bits = max(10, (2 * PIECES_KEPT).bit_length() - 1)
        self.keys = np.zeros(1 << self.bits, _U)
        self.slot = np.full(1 << self.bits, -1, np.int32)
        self.first, self.ids, self.n, self.used = np.zeros(1, np.int64), np.empty(0, dtype), 0, 0

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key's piece, -1 if unknown."""
        out = np.full(len(keys), -1, np.int64)
        at, todo = self._home(keys), np.arange(len(keys))
        while len(todo):
            slot = self.slot[at]
            hit = (slot >= 0) & (self.keys[at] == keys[todo])
            out[todo[hit]] = slot[hit]
            go = (slot >= 0) & ~hit
            todo, at = todo[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, keys: np.ndarray, ids: list[bytes]) -> np.ndarray:
        """Numbers of new pieces; those beyond the bound are forgotten at the next call of ``trim``."""
        size = np.array([len(x) for x in ids], np.int64) // self.ids.dtype.itemsize
        number, end = self.n + np.arange(len(keys)), self.first[self.n] + np.cumsum(size)
        self.first = _room(self.first, self.n + len(keys) + 1)
        self.first[self.n + 1 : self.n + len(keys) + 1] = end
        self.ids = _room(self.ids, int(end[-1]))
        self.ids[end[0] - size[0] : end[-1]] = np.frombuffer(b"".join(ids), self.ids.dtype)
        self.n += len(keys)
        left = np.flatnonzero(number < PIECES_KEPT)
        self.used = min(self.n, PIECES_KEPT)
        at = self._home(keys[left])
        while len(left):
            free = np.flatnonzero(self.slot[at] < 0)
            _, won = np.unique(at[free], return_index=True)
            won = free[won]
            self.keys[at[won]], self.slot[at[won]] = keys[left[won]], number[left[won]]
            stay = np.ones(len(left), bool)
            stay[won] = False
            left, at = left[stay], (at[stay] + 1) & ((1 << self.bits) - 1)
        return number

    def trim(self) -> None:
        self.n = min(self.n, self.used)


def _room(x: np.ndarray, n: int) -> np.ndarray:
    """x with space for n values, grown by half at least."""
    if n <= len(x):
        return x
    out = np.zeros(max(n, len(x) * 3 // 2), x.dtype)
    out[: len(x)] = x
    return out


class PieceEncoder:
    """Ids of texts as little-endian bytes, piece by piece."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = PieceTable(self.dtype)
        feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.feed = feed[0] if len(feed) == 1 else -1

    @staticmethod
    def of(path: str) -> PieceEncoder:
        if path not in _loaded:
            _loaded[path] = PieceEncoder(path)
        return _loaded[path]

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.dtype).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, fresh: list[str]) -> list[bytes]:
        """Ids of pieces of plain texts; those without white space at an end go in one text, split at line feeds."""
        inner = [p for p in fresh if p[-1] not in "\t\n\r " and p[0] not in "\t\n\r"]
        out = {}
        if inner:
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(inner)], add_special_tokens=False)[0].ids, self.dtype)
            at = np.flatnonzero(ids == self.feed)
            if len(at) == len(inner) - 1:
                w = self.dtype.itemsize
                raw, cuts = ids.tobytes(), (np.concatenate([[-1], at, [len(ids)]]) * w).tolist()
                out = {p: raw[lo + w : hi] for p, lo, hi in zip(inner, cuts, cuts[1:])}
        rest = [p for p in fresh if p not in out]
        return list(map((out | dict(zip(rest, self.whole(rest)))).__getitem__, fresh))

    def encode(self, buf: np.ndarray, off: np.ndarray) -> list[bytes]:
        """Ids of each text of a slice."""
        starts, plain = split_pieces(buf, off)
        ends = np.append(starts[1:], len(buf))
        for s in self.special:
            hits = [m.start() for m in re.finditer(re.escape(s), buf.tobytes())]
            plain[np.searchsorted(off, hits, side="right") - 1] = False
        cut = np.searchsorted(starts, off)
        if not plain.all():
            keep = np.repeat(plain, np.diff(cut))
            starts, ends = starts[keep], ends[keep]
            cut = np.concatenate([[0], np.cumsum(np.where(plain, np.diff(cut), 0))])
        hashes = K.span_hashes(buf, starts, ends)
        number = self.known.find(hashes)
        new = np.flatnonzero(number < 0)
        if len(new):
            key, first, back = np.unique(hashes[new], return_index=True, return_inverse=True)
            fresh = [buf[s:e].tobytes().decode() for s, e in zip(starts[new[first]].tolist(), ends[new[first]].tolist())]
            number[new] = self.known.add(key, self.pieces(fresh))[back]
        lo, hi = self.known.first[number], self.known.first[number + 1]
        at, _ = K.runs(lo, hi)
        ids = self.known.ids[at]
        total = np.concatenate([[0], np.cumsum(hi - lo)])[cut].tolist()
        self.known.trim()
        odd = iter(self.whole([buf[off[i] : off[i + 1]].tobytes().decode() for i in np.flatnonzero(~plain).tolist()]))
        return [ids[a:b].tobytes() if p else next(odd) for p, a, b in zip(plain.tolist(), total, total[1:])]


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal prefix-code lengths of at most ``limit`` bits, by package-merge; 0 for a count of 0."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} ids do not fit codes of {limit} bits")
    by = used[np.argsort(counts[used], kind="stable")]
    coins = counts[by].astype(np.int64)
    level, is_coin = coins, [np.ones(n, bool)]
    for _ in range(limit - 1):
        k = len(level) // 2
        packs = level[: 2 * k : 2] + level[1 : 2 * k : 2]
        both = np.concatenate([coins, packs])
        order = np.argsort(both, kind="stable")
        level = both[order]
        is_coin.append(order < n)
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for flags in reversed(is_coin):
        c = int(np.count_nonzero(flags[:take]))
        lengths[:c] += 1
        take = 2 * (take - c)
    out[by] = lengths
    return out


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of each id, ids in code order)."""
    used = np.flatnonzero(lengths)
    by = used[np.lexsort((used, lengths[used]))]
    width = np.int64(1) << (MAX_BITS - lengths[by].astype(np.int64))
    left = np.cumsum(width) - width
    codes = np.zeros(len(lengths), np.uint32)
    codes[by] = left >> (MAX_BITS - lengths[by].astype(np.int64))
    return codes, by


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(bit offset of every STRIDE-th id, payload)."""
    n = lengths[ids].astype(np.int64)
    end = np.cumsum(n)
    at = end - n
    total = int(end[-1]) if len(end) else 0
    value = codes[ids].astype(np.int64) << (24 - n - (at & 7))  # in the three bytes from at's
    out = np.zeros((total + 7) // 8 + 3, np.float64)
    for i in range(3):
        out += np.bincount((at >> 3) + i, weights=(value >> (16 - 8 * i)) & 255, minlength=len(out))
    return at[::STRIDE].astype("<u4") if total < 1 << 32 else at[::STRIDE], out.astype(np.uint8).tobytes()


def make_block(doc_ids: list, ids: list[np.ndarray], lengths: np.ndarray, codes: np.ndarray) -> bytes:
    flat = np.concatenate(ids)
    marks, payload = pack(flat, lengths, codes)
    known = np.array([x is not None for x in doc_ids], np.uint8)
    head = np.array([len(ids), len(flat), len(marks), marks.itemsize], "<i8").tobytes()
    directory = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + known.tobytes() + np.array([len(x) for x in ids], "<i8").tobytes()
    return MAGIC + head + directory + marks.tobytes() + payload


def open_block(block: bytes) -> tuple[list, np.ndarray, np.ndarray, memoryview]:
    """(doc_ids, ids of each, checkpoints, payload)."""
    if block[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    n, _, m, size = np.frombuffer(block, "<i8", 4, 4).tolist()
    p = 36
    doc = np.frombuffer(block, "<i8", n, p)
    known = np.frombuffer(block, np.uint8, n, p + 8 * n)
    count = np.frombuffer(block, "<i8", n, p + 9 * n)
    marks = np.frombuffer(block, f"<u{size}" if size == 4 else "<i8", m, p + 17 * n)
    return [d if k else None for d, k in zip(doc.tolist(), known.tolist())], count, marks.astype(np.int64), memoryview(block)[p + 17 * n + m * size :]


class Decoder:
    def __init__(self, lengths: np.ndarray):
        _, by = canonical(lengths)
        n = lengths[by].astype(np.int64)
        width = np.int64(1) << (MAX_BITS - n)
        self.id, self.bits = (np.zeros(1 << MAX_BITS, np.int32) for _ in range(2))
        self.id[: width.sum()] = np.repeat(by, width)
        self.bits[: width.sum()] = np.repeat(n, width)

    def run(self, blocks: list[tuple[np.ndarray, int, memoryview]]) -> list[np.ndarray]:
        """Ids of each (checkpoints, number of ids, payload): all stretches step by step together."""
        data = np.frombuffer(b"".join(x[2] for x in blocks) + b"\0\0\0", np.uint8).astype(np.uint32)
        window = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
        base = np.cumsum([0, *(len(x[2]) for x in blocks)])[:-1]
        at = np.concatenate([m + 8 * b for (m, _, _), b in zip(blocks, base.tolist())])
        left = np.concatenate([np.minimum(STRIDE, n - STRIDE * np.arange(len(m))) for m, n, _ in blocks])
        out = np.zeros((STRIDE, len(at)), np.int32)
        lanes = np.argsort(-left, kind="stable")
        at, left = at[lanes], left[lanes]
        live = len(at)
        for step in range(int(left.max(initial=0))):
            live = int(np.searchsorted(-left[:live], -step, side="left"))
            at_ = at[:live]
            w = window[at_ >> 3] >> (8 - (at_ & 7)).astype(np.uint32) & 0xFFFF
            out[step, :live] = self.id[w]
            at_ += self.bits[w]
        back = np.empty_like(lanes)
        back[lanes] = np.arange(len(lanes))
        whole, found, k = out.T[back], [], 0
        for m, n, _ in blocks:
            found.append(whole[k : k + len(m)].reshape(-1)[:n])
            k += len(m)
        return found


def _tokenise(path: str, bounds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = PieceEncoder.of(path)
        squeeze = zstandard.ZstdCompressor(level=1)
        end = np.array([END_ID], enc.dtype).tobytes()
        for batch in batches:
            for lo, hi, buf, off in K.slices(batch.column(1)):
                ids = [x + end for x in enc.encode(buf, off)]
                doc = batch.column(0).slice(lo, hi - lo)
                part = np.searchsorted(bounds, doc.fill_null(np.iinfo(np.int64).min).to_numpy(), side="right")
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), doc, pa.array([len(x) // enc.dtype.itemsize for x in ids], pa.int64()), pa.array([squeeze.compress(x) for x in ids], pa.binary())], ["part", "doc_id", "n", "ids"])

    return run


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the ids of the part's documents before each; a part is in one task, in order."""
    _loaded.clear()  # workers live on: the pieces are of no use after the tokenising stage
    sums: dict[int, int] = {}
    for batch in batches:
        part, n = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        before = np.empty(len(n), np.int64)
        for p in np.unique(part).tolist():
            at = np.flatnonzero(part == p)
            run = np.cumsum(n[at])
            before[at] = run - n[at] + sums.get(p, 0)
            sums[p] = sums.get(p, 0) + int(run[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before)], ["part", "doc_id", "n", "ids", "before"])


def _counts(dtype: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _loaded.clear()
        total, open_ = np.zeros(0, np.int64), zstandard.ZstdDecompressor()
        for batch in batches:
            for lo in range(0, len(batch), 256):
                c = np.bincount(np.frombuffer(b"".join(open_.decompress(x.as_py()) for x in batch.column(0)[lo : lo + 256]), dtype))
                if len(c) > len(total):
                    c, total = total, c.astype(np.int64)
                total[: len(c)] += c
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["id", "n"])

    return run


def _encode(dtype: np.dtype, book, offset):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = book.value
        codes, _ = canonical(lengths)
        open_ = zstandard.ZstdDecompressor()
        docs, ids, first, size, last = [], [], 0, 0, None

        def block():
            return pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([len(docs)], pa.int32()), pa.array([size], pa.int64()), pa.array([make_block(docs, ids, lengths, codes)], pa.binary())], ["first_id", "n_docs", "n_ids", "block"])

        for batch in batches:
            for part, doc, n, packed, before in zip(*(c.to_pylist() for c in batch.columns)):
                start = offset.value[part] + before
                if docs and (size + n > BLOCK_IDS or start != last):
                    yield block()
                    docs, ids, size = [], [], 0
                if not docs:
                    first = start
                docs.append(doc)
                ids.append(np.frombuffer(open_.decompress(packed), dtype))
                size += n
                last = start + n
        if docs:
            yield block()

    return run


def _decode(book, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(book.value)
        for batch in batches:
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for k in range(0, len(rows), 8):
                opened = [(first, *open_block(b)) for first, b in rows[k : k + 8]]
                for (first, doc, count, _, _), ids in zip(opened, decoder.run([(m, int(c.sum()), p) for _, _, c, m, p in opened])):
                    end = np.cumsum(count)
                    raw = ids.astype("<u4").tobytes()
                    spans = [(4 * (e - c), 4 * e) for c, e in zip(count.tolist(), end.tolist())]
                    cols = [pa.array(doc, pa.int64()), pa.array(first + end - count), pa.array(count), pa.array([zlib.crc32(raw[lo:hi]) for lo, hi in spans], pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        cols.append(pa.array([raw[lo:hi] for lo, hi in spans], pa.binary()))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(cols, names)

    return run


def write_tokens(docs: DataFrame, tokenizer: str, path: str) -> None:
    """Writes ``path/blocks`` and ``path/book`` of the texts of docs (doc_id long, text string)."""
    spark = bounded(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dtype = PieceEncoder.of(tokenizer).dtype
    n = partitions(spark)
    bounds = np.unique(np.array(docs.select("doc_id").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n) or [], np.float64).astype(np.int64))
    ids = docs.mapInArrow(_tokenise(tokenizer, bounds), "part int, doc_id long, n long, ids binary")
    ids = ids.repartitionById(n, "part").sortWithinPartitions("part", "doc_id", "ids").mapInArrow(_number, "part int, doc_id long, n long, ids binary, before long")
    staged = Staged(ids, "ids", "uncompressed")
    count = staged.df().select("ids").mapInArrow(_counts(dtype), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # at most the vocabulary
    total = np.zeros(int(count["id"].max()) + 1 if len(count) else 1, np.int64)
    total[count["id"].to_numpy(np.int64)] = count["n"].to_numpy(np.int64)
    lengths = code_lengths(total)
    book = spark.sparkContext.broadcast(lengths)
    sums = {r.part: r.n for r in staged.df().groupBy("part").agg(F.sum("n").alias("n")).collect()}  # one row per part
    offset, run = {}, 0
    for p in sorted(sums):
        offset[p], run = run, run + sums[p]
    offset = spark.sparkContext.broadcast(offset)
    staged.df().select("part", "doc_id", "n", "ids", "before").mapInArrow(_encode(dtype, book, offset), "first_id long, n_docs int, n_ids long, block binary").write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    spark.createDataFrame([(bytearray(lengths.tobytes()), MAX_BITS, STRIDE)], "lengths binary, max_bits int, stride int").coalesce(1).write.parquet(f"{path}/book")
    staged.drop()
    release(spark)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids, little-endian unsigned 32-bit) of the files alone."""
    lengths = np.frombuffer(bounded(spark).read.schema("lengths binary, max_bits int, stride int").parquet(f"{path}/book").first().lengths, np.uint8)
    blocks = spark.read.schema("first_id long, n_docs int, n_ids long, block binary").parquet(f"{path}/blocks").select("first_id", "block")
    return blocks.mapInArrow(_decode(spark.sparkContext.broadcast(lengths), with_ids), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def token_digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_tokens(docs, tokenizer, path)
    return read_tokens(spark, path, with_ids=False)


def op3_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_token_binary": op3_token_binary}
ORACLE: dict[str, str] = {}  # tokenising is not SQL; tests/llm/test_op3.py has the plain version
