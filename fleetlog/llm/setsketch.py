"""Near copies by SetSketch registers: banded candidates, joint likelihood estimate, exact check.

A document's set is its distinct 5-word shingles. Register i of a set is the smallest of the
hash values of its members under hash i, taken as an exponential variable and truncated to a grid of powers
of ``BASE``; a union's register is the larger of two. Equal registers grow with the Jaccard
similarity, so bands of registers find candidates; the number of larger, smaller and equal
registers of two sets with known sizes gives the likelihood of every similarity, whose maximum
is the estimate; what is not far below the limit is checked on the full sets.

Work in steps, each written to the shared folder:

1. One sketch a document. Documents with equal sets become one node (partial minimum; any number
   of copies costs one row a task).
2. Every node gives one key for each band. Of a key with several nodes each is compared with one
   centre, the smallest; what passes estimate and check is a link; links make components.
3. Keys whose nodes are still in different components are compared in full, but only across
   components and only sketch with sketch, in blocks of at most ``BLOCK_NODES`` nodes. What passes
   the estimate, in the first band that two nodes share, is checked in the same group, to which
   the full sets of just these nodes come; pairs never become rows. So nothing is left out
   but pairs whose link does not show in any band: with 32 bands of 4, five in a million
   at similarity 0.75, fewer above.

Only step 3 costs more than its input, for keys that hold many nodes which are alike but not
linked: sketches are compared there, no rows are made.

Defined cases: a document without words has an empty set and is linked with nothing. With fewer
than five words the whole sequence is the one shingle. Missing ids are no smallest id; a group
without any id has none. Rows that repeat id and text are copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlog.llm.base import batches_to_rows, stored
from fleetlog.llm.components import components
from fleetlog.llm.wordbytes import SPACE_WORDS, mix, runs, window_hashes, words_of

SHINGLE = 5
SHARE = 75  # least per cent of the union that is common
REGISTERS = 256
BANDS, ROWS = 32, 4
BASE, RATE = 1.001, 20.0
#: Estimates from here on are checked; 0.75 is nearly four standard deviations above.
LEAST_ESTIMATE = 0.65
BLOCK_NODES = 1024
JUDGED_AT_ONCE = 100_000

_A = (mix(np.arange(1, REGISTERS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) + np.uint64(1 << 40)) >> np.uint64(32)).astype(np.uint32)


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The sorted 64-bit hashes of each text's shingles."""
    for lo, hi in runs(texts):
        words = words_of(texts[lo:hi], SPACE_WORDS)
        hashes = window_hashes(words.hash, SHINGLE)
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            if b - a >= SHINGLE:
                yield _distinct(hashes[a : b - SHINGLE + 1])
            else:
                yield window_hashes(words.hash[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def sketch(members: np.ndarray) -> np.ndarray:
    """Registers of a set (uint16)."""
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    x = (members >> np.uint64(32)).astype(np.uint32)[:, None]
    for lo in range(0, len(x), 256):
        part = x[lo : lo + 256] * _A
        part += _B
        np.minimum(least, part.min(0), out=least)
    exponential = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, 65535).astype("<u2")


def estimate(n_a: np.ndarray, n_b: np.ndarray, larger: np.ndarray, smaller: np.ndarray) -> np.ndarray:
    """Most likely similarity of sets of known sizes from their registers' comparison.

    ``larger``, ``smaller``: registers of the first set above and below those of the second.
    """
    u = n_a / (n_a + n_b)
    v = 1 - u
    equal = REGISTERS - larger - smaller

    def chance(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j):
        up, down = chance(u - v * j), chance(v - u * j)
        with np.errstate(divide="ignore", invalid="ignore"):
            terms = [np.where(k > 0, k * np.log(p), 0.0) for k, p in ((larger, up), (smaller, down), (equal, 1 - up - down))]
        return sum(np.where(np.isnan(t), -np.inf, t) for t in terms)

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):  # the logarithm of the likelihood has one peak
        a, b = lo + (hi - lo) * 0.382, lo + (hi - lo) * 0.618
        right = likelihood(a) < likelihood(b)
        lo, hi = np.where(right, a, lo), np.where(right, hi, b)
    return (lo + hi) / 2


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """The rule itself, on full sets."""
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= SHARE * (len(both) - common)


def text_hash(text: Column) -> Column:
    """Tells the texts of one id apart when a row is looked up again."""
    return F.xxhash64(text)


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``doc_id``, ``tie`` (hash of the text), ``n`` (set size), ``node`` (128-bit hash of the set) and ``regs``."""
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_hash(F.col(f"`{text}`")).alias("tie"), F.col(f"`{text}`").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> dict:
        n, node, regs = [], [], []
        for members in shingle_sets(batch.column(2).to_pylist()):
            n.append(len(members))
            node.append(np.array([members.sum(dtype=np.uint64), mix(members).sum(dtype=np.uint64)], "<u8").tobytes() if len(members) else None)
            regs.append(sketch(members).tobytes() if len(members) else None)
        return {"doc_id": batch.column(0), "tie": batch.column(1), "n": n, "node": node, "regs": regs}

    return batches_to_rows(source, f"doc_id {kind}, tie long, n long, node binary, regs binary", work)


def _first_id() -> Column:
    """The order of rows in a group: by id, missing ones last."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, REGISTERS)


def _keys(regs: np.ndarray) -> np.ndarray:
    """Node x band -> key: the band's registers and its number, mixed."""
    packed = np.ascontiguousarray(regs[:, : BANDS * ROWS]).view("<u8")
    return mix(packed + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def _band_rows(batch: pa.RecordBatch) -> dict:
    keys = _keys(_registers(batch.column(1)))
    return {"nid": np.repeat(batch.column(0).to_numpy(), BANDS), "key": keys.ravel()}


def _promising(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose estimate is high enough."""
    side = lambda x: nodes.select(F.col("nid").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"r_{x}"))

    def work(batch: pa.RecordBatch) -> dict:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(a):
            return {"a": a, "b": b}
        ra, rb = _registers(batch.column(3)), _registers(batch.column(5))
        high = estimate(batch.column(2).to_numpy(), batch.column(4).to_numpy(), (ra > rb).sum(1), (ra < rb).sum(1)) >= LEAST_ESTIMATE
        return {"a": a[high], "b": b[high]}

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "r_a", "n_b", "r_b")
    return batches_to_rows(both, "a long, b long", work)


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs that are links on their full sets."""

    def work(batch: pa.RecordBatch) -> dict:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        ok = [linked(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
        return {"a": [x for x, y in zip(a, ok, strict=True) if y], "b": [x for x, y in zip(b, ok, strict=True) if y]}

    side = lambda x: sets.select(F.col("nid").alias(x), F.col("members").alias(f"m_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "m_a", "m_b")
    return batches_to_rows(both, "a long, b long", work)


def _sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Full sets of some nodes (nid, first), made again from a text of each."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("i"), F.col(f"`{text}`").alias("x")).withColumn("t", text_hash(F.col("x")))
    found = rows.join(wanted, (rows.t == F.col("first.tie")) & rows.i.eqNullSafe(F.col("first.doc_id"))).select("nid", "x")
    found = found.dropDuplicates(["nid"])  # where a row is repeated

    def work(batch: pa.RecordBatch) -> dict:
        return {"nid": batch.column(0), "members": [m.astype("<u8").tobytes() for m in shingle_sets(batch.column(1).to_pylist())]}

    return batches_to_rows(found, "nid long, members binary", work)


def _across(rows: DataFrame) -> DataFrame:
    """Nodes with their promising partners across components within each key, by their sketches.

    Rows (key, nid, root, n, regs, blocks): a node goes into one of ``blocks`` blocks of its key;
    each pair of blocks is a group, so a group has at most about twice ``BLOCK_NODES`` nodes.
    """
    rows = rows.withColumn("p", F.pmod(F.xxhash64("nid"), F.col("blocks")))
    rows = rows.withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi"), (F.col("p") > F.col("q")).alias("second"), "nid", "root", "n", "regs")

    return _by_group(rows, "key long, lo long, hi long, nid long, root long, partners array<long>", _pairs_across)


def _by_group(rows: DataFrame, schema: str, work) -> DataFrame:
    """Run ``work`` on whole groups (key, lo, hi), as many at once as a batch holds."""
    together = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "nid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            part = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]).combine_chunks()
            if not part.num_rows:
                continue
            group = _groups(part)
            last = int(np.flatnonzero(group == group[-1])[0])  # may go on in the next batch
            if last:
                yield work(part.slice(0, last), group[:last])
            held = part.slice(last)
        if held is not None and held.num_rows:
            yield work(held, _groups(held))

    return together.mapInArrow(run, schema)


def _groups(rows: pa.Table) -> np.ndarray:
    """A number for each run of rows with the same key and pair of blocks."""
    columns = [rows[c].to_numpy() for c in ("key", "lo", "hi")]
    changed = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.concatenate([[0], np.cumsum(changed)])


def _pairs_across(rows: pa.Table, group: np.ndarray) -> pa.RecordBatch:
    """Pairs that are in different components and whose estimate is high enough.

    One row a node that is in such a pair, with its partners; no row a pair.

    All groups at once: step d compares every row with the d-th row after it, as long as both are in
    one group, so the number of steps is the size of the largest group.
    """
    nid, root, size = (rows[c].to_numpy() for c in ("nid", "root", "n"))
    second, alone = rows["second"].to_numpy(), rows["lo"].to_numpy() == rows["hi"].to_numpy()
    regs = _registers(rows["regs"].combine_chunks() if isinstance(rows["regs"], pa.ChunkedArray) else rows["regs"])
    keys, key = _keys(regs), rows["key"].to_numpy()
    here = (keys == key[:, None]).argmax(1)  # the band that made the key
    out_a, out_b, near_pairs = [], [], []

    def judge() -> None:
        """Estimates of many pairs at once."""
        if near_pairs:
            i, j, larger, smaller = (np.concatenate(x) for x in zip(*near_pairs, strict=True))
            high = estimate(size[i], size[j], larger, smaller) >= LEAST_ESTIMATE
            out_a.append(i[high])
            out_b.append(j[high])
            near_pairs.clear()

    at = np.arange(len(nid))
    step = held = 0
    while True:
        step += 1
        at = at[at + step < len(nid)]
        at = at[group[at] == group[at + step]]
        if not len(at):
            break
        i, j = at, at + step
        # of two blocks only pairs from one to the other; sizes alone bound the similarity
        some = (root[i] != root[j]) & (alone[i] | (second[i] != second[j]))
        some &= 100 * np.minimum(size[i], size[j]) >= SHARE * np.maximum(size[i], size[j])
        i, j = i[some], j[some]
        if not len(i):
            continue
        # once only: in the first band the two share
        first = (keys[i] == keys[j]).argmax(1) == here[i]
        i, j = i[first], j[first]
        larger, smaller = (regs[i] > regs[j]).sum(1), (regs[i] < regs[j]).sum(1)
        near = REGISTERS - larger - smaller >= (LEAST_ESTIMATE - 0.1) * REGISTERS
        near_pairs.append((i[near], j[near], larger[near], smaller[near]))
        held += int(near.sum())
        if held > JUDGED_AT_ONCE:
            judge()
            held = 0
    judge()
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (out_a, out_b))
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    used = np.unique(np.concatenate([a, b]))
    ends = np.searchsorted(a, used, side="right")
    partners = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(nid[b], pa.int64()))
    columns = [rows[c].to_numpy()[used] for c in ("key", "lo", "hi", "nid", "root")]
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), partners], names=["key", "lo", "hi", "nid", "root", "partners"])


def _links_across(rows: pa.Table, group: np.ndarray) -> pa.RecordBatch:
    """Links among the pairs of whole groups; none between nodes that links of the group join already."""
    out_a, out_b = [], []
    members, partners = rows["members"].combine_chunks(), rows["partners"].combine_chunks()
    nid, root = rows["nid"].to_numpy(), rows["root"].to_numpy()
    for part in np.split(np.arange(len(group)), np.flatnonzero(np.diff(group)) + 1):
        at = {int(nid[k]): k for k in part}
        parent = {int(root[k]): int(root[k]) for k in part}

        def find(x: int, parent: dict = parent) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        sets: dict[int, np.ndarray] = {}

        def full(k: int, sets: dict = sets) -> np.ndarray:
            if k not in sets:
                sets[k] = np.frombuffer(members[int(k)].as_buffer(), "<u8")
            return sets[k]

        for k in part:
            for other in partners[int(k)].as_py():
                j = at[other]
                x, y = find(int(root[k])), find(int(root[j]))
                if x != y and linked(full(k), full(j)):
                    parent[x] = y
                    out_a.append(int(nid[k]))
                    out_b.append(other)
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (out_a, out_b)], names=["a", "b"])


def _linked_across(found: DataFrame, sets: DataFrame) -> DataFrame:
    with_sets = found.join(sets.select(F.col("nid").alias("of"), "members"), F.col("nid") == F.col("of")).drop("of")
    return _by_group(with_sets, "a long, b long", _links_across)


def nodes_and_links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sketch rows of all documents, the nodes (nid, node, first, n, regs), and (node nid, root) of linked ones."""
    rows = stored(sketches(docs, doc_id, text), "sketches")
    nodes = rows.where("n > 0").groupBy("node").agg(F.min(_first_id()).alias("first"), F.max("n").alias("n"), F.max("regs").alias("regs"))
    # the number is fixed by the write; nothing depends on which it is but which node is a centre
    nodes = stored(nodes.withColumn("nid", F.monotonically_increasing_id()), "nodes")
    bands = stored(batches_to_rows(nodes.select("nid", "regs"), "nid long, key long", _band_rows), "bands")
    centres = bands.groupBy("key").agg(F.min("nid").alias("centre"), F.count(F.lit(1)).alias("held")).where("held > 1")
    shared = stored(bands.join(centres, "key"), "shared")
    wanted = shared.select("nid").distinct().join(nodes.select("nid", "first"), "nid")
    sets = stored(_sets(docs, wanted, doc_id, text), "sets")
    stars = shared.where("nid <> centre").select(F.col("centre").alias("a"), F.col("nid").alias("b")).distinct()
    # one Python step a stage: each keeps its own workers in an executor's memory
    stars = stored(_promising(stars, nodes), "stars")
    links = stored(_checked(stars, sets), "links")
    roots = components(links)

    labelled = shared.select("key", "nid", "held").join(roots, F.col("nid") == F.col("node"), "left").select(
        "key", "nid", "held", F.coalesce("root", "nid").alias("root")
    )
    labelled = stored(labelled, "labelled")
    split = labelled.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    open_rows = labelled.join(split, "key").join(nodes.select("nid", "n", "regs"), "nid")
    open_rows = open_rows.select("key", "nid", "root", "n", "regs", F.ceil(F.col("held") / BLOCK_NODES).cast("long").alias("blocks"))
    across = stored(_across(open_rows), "across")
    more = stored(_linked_across(across, sets), "links")
    return rows, nodes, components(links.unionByName(more))


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``doc_id``, ``n_shingles``, ``component_id`` and ``kept``."""
    rows, nodes, roots = nodes_and_links(docs, doc_id, text)
    grouped = _grouped(nodes, roots)
    low = grouped.groupBy("group").agg(F.min("first.doc_id").alias("component_id")).withColumnRenamed("group", "g")
    named = grouped.join(low, F.col("group") == F.col("g")).select(F.col("node").alias("set"), "component_id")
    out = rows.select("doc_id", "n", "node").join(named, F.col("node") == F.col("set"), "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _grouped(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    roots = roots.withColumnRenamed("node", "linked")
    return nodes.join(roots, F.col("nid") == F.col("linked"), "left").select("node", "first", F.coalesce("root", "nid").alias("group"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near copies (the smallest id), and every document without words."""
    _, nodes, roots = nodes_and_links(docs, doc_id, text)
    first = _grouped(nodes, roots).groupBy("group").agg(F.min("first").alias("first")).select(
        F.col("first.doc_id").alias("keep_id"), F.col("first.tie").alias("keep_tie")
    )
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{doc_id}`").alias("i"), text_hash(F.col(f"`{text}`")).alias("t"), F.col(f"`{text}`").alias("x"))
    worded = F.coalesce(F.col("x").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    empty = rows.where(~worded).select("row")
    kept = rows.where(worded).drop("x").join(first, F.col("i").eqNullSafe(F.col("keep_id")) & (F.col("t") == F.col("keep_tie")), "left_semi")
    return kept.dropDuplicates(["i", "t"]).select("row").unionByName(empty).select("row.*")
