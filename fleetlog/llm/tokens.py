"""Token files: documents as ids of a public tokenizer, Re-Pair compressed, with random access.

``write`` puts documents in ascending order of their id into contiguous shards (a range shuffle),
encodes each, ends it with an id of its own, and compresses blocks of about ``BLOCK_IDS`` ids.
A block is one self-contained record in the format below. Records are stored as the rows of a
Parquet folder in order of (shard, block): Spark's committer makes the write safe when executors
are lost, and any store that Spark reads will do. ``read`` needs nothing but the records.

A record, little-endian, in this order:

    magic "RPID", version u16, width u16 of a symbol in bytes (2 or 4)
    u32 base (first nonterminal), u32 rules, u32 documents, u64 symbols
    rules x (u32 left, u32 right)
    rules x u32 expansion length in ids
    (documents + 1) x u64 first symbol of each document
    (documents + 1) x u64 first id of each document
    symbols

Re-Pair replaces frequent pairs by nonterminals, again and again. A round counts all pairs of a
block at once and replaces every frequent one where it does not overlap a more frequent one; rounds
end when no pair is frequent. Pairs never run over the end of a document, so a document, and with
the expansion lengths a range of its ids, is decoded alone (``Block.ids``).

Encoding goes word by word: the tokenizer must lower-case, drop white space and never look across
it (its file says so, and ``Encoder`` compares a probe), so a text's ids are those of its words in
a row, and a repeated word is encoded once per task.

Defined cases: a missing text is empty; an empty one has its end id only. Rows with a missing id
come first; rows of the same id are ordered by a hash of their text. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain, count
from string import ascii_lowercase

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlog.llm.base import batches_to_rows, shared_dir
from fleetlog.llm.wordbytes import SPACE_WORDS, runs, words_of

BLOCK_IDS = 1 << 20
SHARD_CHARS = 128_000_000
END_ID = 1
#: A pair has to occur so often in a block; rarer ones save less than wider symbols cost (README).
LEAST_COUNT = 32
#: Words whose ids a task remembers; the memory is emptied when full.
REMEMBERED = 1_500_000
_MAGIC = b"RPID"
_HEAD = np.dtype([("magic", "S4"), ("version", "<u2"), ("width", "<u2"), ("base", "<u4"), ("rules", "<u4"), ("docs", "<u4"), ("symbols", "<u8")])


class _Letters(dict):
    """The symbols the tokenizer's splitter writes for a letter."""

    def __init__(self, tokenizer):
        super().__init__()
        self.split = tokenizer.pre_tokenizer.pre_tokenize_str

    def __missing__(self, letter: str) -> str:
        self[letter] = "".join(x for x, _ in self.split(letter))
        return self[letter]


class Encoder:
    """A tokenizer and the ids of the words it has met.

    Words are told apart by 64-bit hashes. A word of lower-case Latin letters, which normaliser and
    splitter leave as it is, goes to the tokenizer's model at once; any other takes the whole way.
    """

    _loaded: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.base = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.letters = _Letters(self.tokenizer)
        self.own_letters = all(self.letters[c] == c for c in ascii_lowercase)
        self._forget()
        self._check()
        self._forget()

    def _forget(self) -> None:
        """What is known of words: their hashes, where their ids lie in ``flat``, and a table from hash to word.

        Word 0 is the end of a text. The table is open: a word stands in the first free cell from that of
        its hash on, and there are at least two cells a word.
        """
        self.count, self.used = 1, 1
        self.hashes, self.begin, self.size = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.int64), np.ones(1 << 12, np.int32)
        self.flat = np.zeros(1 << 14, np.uint32)
        self.bits = 13
        self.cells = np.full(1 << self.bits, -1, np.int32)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The word of each hash, or -1."""
        mask, found = (1 << self.bits) - 1, np.full(len(hashes), -1, np.int64)
        asked = np.arange(len(hashes))
        cell = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(asked):
            word = self.cells[cell]
            same = (word >= 0) & (self.hashes[word] == hashes[asked])
            found[asked[same]] = word[same]
            on = (word >= 0) & ~same
            asked, cell = asked[on], (cell[on] + 1) & mask
        return found

    def _put(self, words: np.ndarray) -> None:
        """Words that are not in the table yet, each in a cell of its own."""
        mask = (1 << self.bits) - 1
        cell = (self.hashes[words] >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(words):
            free = self.cells[cell] < 0
            self.cells[cell[free]] = words[free]
            on = self.cells[cell] != words  # taken before, or by another of these words
            words, cell = words[on], (cell[on] + 1) & mask

    def _learn(self, hashes: np.ndarray, spelled: list[bytes]) -> None:
        words = [b.decode("utf-8", "replace") for b in spelled]
        # words of a-z are spelled as they are; other small Latin letters by the splitter's symbols
        plain = [b.isalpha() and b.islower() and self.own_letters for b in spelled]  # bytes: ASCII letters only
        near = [not p and w.isalpha() and w.lower() == w and max(w) < "\u0250" for w, p in zip(words, plain, strict=True)]
        whole = [w for w, p, q in zip(words, plain, near, strict=True) if not (p or q)]
        full = iter(self.tokenizer.encode_batch_fast(whole, add_special_tokens=False))
        tokenize, letters = self.tokenizer.model.tokenize, self.letters
        lists = [
            [t.id for t in tokenize(w)] if p else [t.id for t in tokenize("".join([letters[c] for c in w]))] if q else next(full).ids
            for w, p, q in zip(words, plain, near, strict=True)
        ]
        size = np.array([len(x) for x in lists], np.int64)
        n, ids = self.count + len(hashes), self.used + int(size.sum())
        while len(self.hashes) < n:
            self.hashes, self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.hashes, self.begin, self.size))
        while len(self.flat) < ids:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        new = slice(self.count, n)
        self.hashes[new], self.size[new], self.begin[new] = hashes, size, self.used + np.cumsum(size) - size
        self.flat[self.used : ids] = np.fromiter(chain.from_iterable(lists), np.uint32, ids - self.used)
        fresh = np.arange(self.count, n, dtype=np.int32)
        self.count, self.used = n, ids
        if 2 * n > len(self.cells):
            self.bits = (2 * n - 1).bit_length()
            self.cells, fresh = np.full(1 << self.bits, -1, np.int32), np.arange(1, n, dtype=np.int32)
        self._put(fresh)

    def _check(self) -> None:
        probe = "Two words, l'Été 12.5%; don't “stop”.\n  a_b <|x|> Straße…"
        if self.encode([probe, None])[0].tolist() != [*self.tokenizer.encode(probe, add_special_tokens=False).ids, END_ID, END_ID]:
            raise ValueError("this tokenizer looks across white space or keeps case")

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One for each Python worker: loading takes longer than a small task."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def encode(self, texts: list[str | None], end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text begins (one more entry than texts)."""
        special = any(t and "<|" in t for t in texts)  # such strings are ids of their own only as they are written
        words = words_of(texts, SPACE_WORDS, lower=not special, apart=b"" if special else b".,;:!?")
        codes, uniques = pd.factorize(words.hash)
        if self.count > REMEMBERED:
            self._forget()
        self.flat[0] = end_id
        place = self._find(uniques)
        missing = place < 0
        if missing.any():
            where = np.empty(len(uniques), np.int64)
            where[codes] = np.arange(len(codes))
            place[missing] = np.arange(self.count, self.count + int(missing.sum()))
            spelled, raw = where[missing], words.data.tobytes()
            self._learn(uniques[missing], [raw[a:b] for a, b in zip(words.start[spelled].tolist(), words.end[spelled].tolist(), strict=True)])
        # a text's end is one more word behind its own
        ends = words.first[1:] + np.arange(len(texts))
        inside = np.ones(len(codes) + len(texts), bool)
        inside[ends] = False
        sequence = np.zeros(len(inside), np.int32)
        sequence[inside] = place.astype(np.int32)[codes]
        lengths = self.size[sequence]
        upto = np.cumsum(lengths, dtype=np.int64)
        total = int(upto[-1]) if len(upto) else 0
        # steps from id to id in ``flat``: 1 inside a word, a jump to the next one's begin at its border
        step = np.ones(total, np.int64)
        begin = self.begin[sequence]
        first = upto - lengths
        some = lengths > 0
        first, begin, last = first[some], begin[some], (begin + lengths - 1)[some]
        step[first[1:]] = begin[1:] - last[:-1]
        if total:
            step[0] = begin[0]
        ids = self.flat[np.cumsum(step, out=step)]
        bounds = np.concatenate([[0], upto[ends]])
        return ids, bounds


def _counted(pair: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that occur at least so often, and how often."""
    pair = np.sort(pair)
    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(pair)))
    some = counts >= least
    return pair[first[some]], counts[some]


def _cells(pair: np.ndarray, turn: int, bits: int) -> np.ndarray:
    kind, width = pair.dtype.type, 8 * pair.dtype.itemsize
    salt = kind((0x9E3779B97F4A7C15 >> (64 - width)) | 1) + kind(2 * turn)
    return (pair * salt) >> kind(width - bits)


def _still(pair: np.ndarray, inner: np.ndarray, known: np.ndarray, least: int, bits: int = 18) -> tuple[np.ndarray, np.ndarray]:
    """Which of the known pairs occur at least so often, and how often."""
    known = np.sort(known)
    there = np.zeros(1 << bits, bool)
    there[_cells(known, 0, bits)] = True
    some = pair[there[_cells(pair, 0, bits)] & inner]
    at = np.minimum(np.searchsorted(known, some), len(known) - 1)
    counts = np.bincount(at[known[at] == some], minlength=len(known))
    return known[counts >= least], counts[counts >= least]


def _found(pair: np.ndarray, inner: np.ndarray, common: np.ndarray, turn: int, bits: int = 18) -> tuple[np.ndarray, np.ndarray]:
    """Where inner pairs are in ``common``, and their ranks there.

    A table without chains: of two common pairs in one cell the more frequent one stays, the other
    waits for the next round, whose table has another salt.
    """
    table = np.full(1 << bits, -1, np.int32)
    table[_cells(common[::-1], turn, bits)] = np.arange(len(common), dtype=np.int32)[::-1]
    cell = _cells(pair, turn, bits)
    at = np.flatnonzero((table >= 0)[cell] & inner)
    rank = table[cell[at]]
    same = common[rank] == pair[at]
    return at[same], rank[same]


def compress(ids: np.ndarray, bounds: np.ndarray, base: int, least: int = LEAST_COUNT) -> bytes:
    """One record from the ids of some documents (``bounds``: where each begins, and the end)."""
    base = max(base, int(ids.max()) + 1 if len(ids) else 0)
    seq = ids.astype(np.uint32)
    end = np.zeros(len(seq), bool)
    end[bounds[1:][bounds[1:] > bounds[:-1]] - 1] = True
    left, right, size = [], [], [np.ones(base, np.int64)]
    made = 0
    for turn in count():
        wide = base + made > 1 << 16
        pair = seq[:-1].astype(np.uint64 if wide else np.uint32)
        pair <<= pair.dtype.type(32 if wide else 16)
        pair |= seq[1:].astype(pair.dtype)
        inner = ~end[:-1]
        if turn == 0 or pair.dtype != common.dtype:
            common, counts = _counted(pair[inner], least)
        else:
            # a pair that has become frequent holds a symbol of the last round; any other was frequent before
            new = seq >= base + made - len(keep)
            known = _still(pair, inner, common, least)
            common, counts = (np.concatenate(x) for x in zip(known, _counted(pair[(new[:-1] | new[1:]) & inner], least), strict=True))
        if not len(common):
            break
        common = common[np.lexsort((common, -counts))]
        none = len(common)
        at, rank = _found(pair, inner, common, turn)
        before, after = np.full(len(at), none, np.int32), np.full(len(at), none, np.int32)
        near = at[1:] == at[:-1] + 1
        before[1:][near], after[:-1][near] = rank[:-1][near], rank[1:][near]
        # in a run of one pair (aaaa) every second place: equal neighbours never overlap
        head = np.maximum.accumulate(np.where(rank != before, at, 0))
        some = (rank <= before) & (rank <= after) & ((at - head) % 2 == 0)
        take, rank = at[some], rank[some]
        used = np.bincount(rank, minlength=none)
        keep = np.flatnonzero(used >= min(4, least))  # fewer do not pay for their rule
        if not len(keep):
            break
        number = np.full(none + 1, -1, np.int64)
        number[keep] = base + made + np.arange(len(keep))
        kept = number[rank] >= 0
        take, rank = take[kept], rank[kept]
        chosen = common[keep].astype(np.uint64)
        shift = np.uint64(32 if wide else 16)
        left.append((chosen >> shift).astype(np.uint32))
        right.append((chosen & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.uint32))
        known = np.concatenate(size)
        size.append(known[left[-1]] + known[right[-1]])
        made += len(keep)
        seq[take] = number[rank]
        gone = np.zeros(len(seq), bool)
        gone[take + 1] = True
        end[take] = end[take + 1]
        seq, end = seq[~gone], end[~gone]
    width = 2 if base + made <= 1 << 16 else 4
    symbol_at = np.zeros(len(bounds), np.int64)
    closed = np.flatnonzero(end) + 1
    symbol_at[1:][bounds[1:] > bounds[:-1]] = closed
    symbol_at = np.maximum.accumulate(symbol_at)
    head = np.array([(_MAGIC, 1, width, base, made, len(bounds) - 1, len(seq))], _HEAD)
    rules = np.stack([np.concatenate(left), np.concatenate(right)], 1) if made else np.zeros((0, 2), np.uint32)
    lengths = np.concatenate(size[1:]) if made else np.zeros(0, np.int64)
    return b"".join(
        x.tobytes() for x in (head, rules.astype("<u4"), lengths.astype("<u4"), symbol_at.astype("<u8"), bounds.astype("<u8"), seq.astype(f"<u{width}"))
    )


class Block:
    """A record, ready for random access."""

    def __init__(self, record: bytes):
        head = np.frombuffer(record, _HEAD, 1)[0]
        if head["magic"] != _MAGIC:
            raise ValueError("not a token record")
        at, n, d = _HEAD.itemsize, int(head["rules"]), int(head["docs"])

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(record, kind, count, at)
            at += out.nbytes
            return out

        self.base = int(head["base"])
        rules = take("<u4", 2 * n).reshape(n, 2).astype(np.int64)
        self.size = take("<u4", n).astype(np.int64)
        self.symbol_at = take("<u8", d + 1).astype(np.int64)
        self.bounds = take("<u8", d + 1).astype(np.int64)
        self.seq = take(f"<u{head['width']}", int(head["symbols"]))
        # every rule names earlier symbols, so expansions are laid out in one pass over the rules
        self.flat_at = np.concatenate([[0], np.cumsum(self.size)])
        self.flat = np.zeros(self.flat_at[-1], np.uint32)
        for k, (a, b) in enumerate(rules.tolist()):
            at_k = self.flat_at[k]
            for part in (a, b):
                if part < self.base:
                    self.flat[at_k] = part
                    at_k += 1
                else:
                    lo, hi = self.flat_at[part - self.base], self.flat_at[part - self.base + 1]
                    self.flat[at_k : at_k + hi - lo] = self.flat[lo:hi]
                    at_k += hi - lo

    def _expand(self, seq: np.ndarray) -> np.ndarray:
        """Ids of some symbols: those of the rules lie in ``flat``, the others behind it."""
        if not len(seq):
            return np.zeros(0, np.uint32)
        whole = np.concatenate([self.flat, np.arange(self.base, dtype=np.uint32)])
        begin_of = np.concatenate([len(self.flat) + np.arange(self.base), self.flat_at[:-1]])
        length_of = np.concatenate([np.ones(self.base, np.int64), self.size])
        begin, length = begin_of[seq], length_of[seq]
        upto = np.cumsum(length)
        # from id to id: 1 inside an expansion, a jump to the next one's begin at its end
        step = np.ones(int(upto[-1]), np.int64)
        step[0] = begin[0]
        step[upto[:-1]] = begin[1:] - (begin + length - 1)[:-1]
        return whole[np.cumsum(step, out=step)]

    def all_ids(self) -> np.ndarray:
        return self._expand(self.seq)

    def ids(self, document: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Ids lo to hi of one document; only the symbols that hold them are expanded."""
        seq = self.seq[self.symbol_at[document] : self.symbol_at[document + 1]].astype(np.int64)
        length = np.ones(len(seq), np.int64)
        length[seq >= self.base] = self.size[seq[seq >= self.base] - self.base]
        upto = np.cumsum(length)
        hi = int(upto[-1]) if hi is None and len(upto) else hi or 0
        a, b = np.searchsorted(upto, lo, side="right"), np.searchsorted(upto, hi, side="left") + 1
        skipped = int(upto[a - 1]) if a else 0
        return self._expand(seq[a:b])[lo - skipped : hi - skipped]


def write(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Write the records of all documents as a Parquet folder with shard, block, doc_ids, ids, record."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    chars = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // SHARD_CHARS))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    rows = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).drop("tie")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, shard, block = Encoder.of(tokenizer), TaskContext.get().partitionId(), 0
        ids, sizes, keys, held = [], [], [], 0

        def record() -> pa.RecordBatch:
            bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
            packed = compress(np.concatenate(ids), bounds, encoder.base)
            columns = [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([keys], pa.list_(pa.int64())), pa.array([int(bounds[-1])], pa.int64()), pa.array([packed], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["shard", "block", "doc_ids", "ids", "record"])

        for batch in batches:
            texts, names = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for lo, hi in runs(texts):
                some, bounds = encoder.encode(texts[lo:hi], end_id)
                ids.append(some), sizes.append(np.diff(bounds)), keys.extend(names[lo:hi])
                held += len(some)
                if held >= block_ids:
                    yield record()
                    ids, sizes, keys, held, block = [], [], [], 0, block + 1
        if keys:
            yield record()

    records = rows.mapInArrow(encode, "shard int, block int, doc_ids array<bigint>, ids bigint, record binary")
    records.write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents from the records: ``doc_id``, ``start`` (ids before it), ``ids``: array<int>."""
    return _decoded(spark, path, "array<long>", lambda ids: ids.tolist())


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document ``doc_id``, ``start``, ``n_tokens`` and the crc32 of its decoded ids."""
    return _decoded(spark, path, "long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes())).withColumnRenamed("value", "ids_crc32")


def _decoded(spark: SparkSession, path: str, kind: str, of_ids) -> DataFrame:
    files = spark.read.parquet(path)
    # two running sums: over the shards (one row each), and over the blocks of a shard
    sums = files.groupBy("shard").agg(F.sum("ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = sums.select(F.col("shard").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    within = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("shard", "block", F.coalesce(F.sum("ids").over(within), F.lit(0)).alias("in_shard"))
    starts = starts.join(shards, starts.shard == shards.s).select(
        F.col("shard").alias("s"), F.col("block").alias("b"), (F.col("in_shard") + F.col("shard_start")).alias("block_start")
    )
    work = lambda batch: _rows_of(batch, of_ids)
    docs = batches_to_rows(files.select("shard", "block", "doc_ids", "record"), f"shard int, block int, doc_id long, offset long, n_tokens long, value {kind}", work)
    joined = docs.join(starts, (docs.shard == starts.s) & (docs.block == starts.b))
    return joined.select("doc_id", (F.col("block_start") + F.col("offset")).alias("start"), "n_tokens", "value")


def _rows_of(batch: pa.RecordBatch, of_ids) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in ("shard", "block", "doc_id", "offset", "n_tokens", "value")}
    for shard, block, names, record in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
        b = Block(record)
        ids = b.all_ids()
        bounds = b.bounds.tolist()
        out["shard"] += [shard] * len(names)
        out["block"] += [block] * len(names)
        out["doc_id"] += names
        out["offset"] += bounds[:-1]
        out["n_tokens"] += np.diff(b.bounds).tolist()
        out["value"] += [of_ids(ids[lo:hi]) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


def encode_documents(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write all documents below the session's shared folder, and the digests read from there."""
    path = shared_dir(docs.sparkSession, "tokens")
    write(docs, path, tokenizer, **options)
    return digests(docs.sparkSession, path)
