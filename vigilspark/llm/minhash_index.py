"""MinHash near-duplicates by a multi-index Hamming join, exact Jaccard check.

A text's set is its distinct five-word shingles (64-bit hashes).  Each of
``SYMBOLS`` hash functions gives the low ``b`` = 8 bits of its least value over the
set; two sets of similarity s differ in a symbol with probability (1 - s) * 255/256,
so links at 0.85 lie within ``RADIUS`` of 40 symbols but for 6 in 100,000.

Signatures are split into ``CHUNKS`` chunks.  By pigeonhole a pair within the radius
has a chunk with at most ``RADIUS // CHUNKS`` = 1 error; every allowed error is
enumerated by leaving out one symbol of the chunk, and what remains is the
bucket's key.  So every pair within the radius meets in some bucket, surely; in a
bucket the whole signatures and the set sizes are compared.  The pairs that pass
connect candidate groups; each group's full sets are then compared exactly
(``100 * intersection >= percent * union``), and only the links of a spanning forest are
written, never all pairs.

Groups (buckets, then candidate groups) are read in key and size order from
range partitions, so a large one is spread by construction.  One that lies whole
inside a task and is no larger than a block is searched there; the others are cut
into blocks of bounded size, and all pairs of blocks whose sizes allow a link are
searched as tasks of their own.  No pair is lost and no task holds more than two
blocks (a single set larger than a block is a block).

Equal sets are one node; copies are never compared.  The full sets are made again
from the texts of candidate groups alone, so they are never written for all.

Defined cases: a text with fewer than five words has its whole sequence as its one
shingle; without words (null, empty) it is linked with nothing and keeps its own
id; repeated rows give a row each; rows without an id take part, and a component
of such rows alone has a null component_id; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, stage, text_key
from .components import components
from .words import split_words

SHINGLE, PERCENT = 5, 85
CHUNKS, CHUNK = 8, 5
SYMBOLS = CHUNKS * CHUNK
RADIUS = 2 * CHUNKS - 1
SEED = 12
BLOCK_NODES = 4096       # signatures of a block
BLOCK_HASHES = 1 << 18   # shingles of a block of full sets


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    w = split_words(texts)
    own = np.array([xxhash.xxh64_intdigest(x) for x in w.words.cast(pa.binary()).to_pylist()], np.uint64)[w.codes] if len(w.codes) else np.zeros(0, np.uint64)
    factors = np.random.default_rng(SEED).integers(1, 1 << 63, size, np.uint64) * np.uint64(2) + np.uint64(1)

    def mixed(x, length):
        x = x + np.uint64(length * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))

    n = max(len(own) - size + 1, 0)
    windows = np.zeros(n, np.uint64)
    for k in range(size):
        windows += own[k:k + n] * factors[k]
    windows = mixed(windows, size)
    sets = []
    for a, b in zip(w.offsets[:-1].tolist(), w.offsets[1:].tolist()):
        if b - a >= size:
            sets.append(np.unique(windows[a:b - size + 1]))
        else:  # the whole sequence
            sets.append(mixed((own[a:b] * factors[:b - a]).sum(keepdims=True, dtype=np.uint64), b - a) if b > a else np.zeros(0, np.uint64))
    return sets


def signatures(sets: list[np.ndarray], symbols: int = SYMBOLS) -> np.ndarray:
    """One row of ``symbols`` bytes per set, none of them empty."""
    r = np.random.default_rng(SEED + 1)
    a = r.integers(0, 1 << 63, symbols, np.uint64) * np.uint64(2) + np.uint64(1)
    b = r.integers(0, 1 << 63, symbols, np.uint64)
    joined, starts = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), symbols), np.uint8)
    for i in range(symbols):
        out[:, i] = np.minimum.reduceat(joined * a[i] + b[i], starts).astype(np.uint8)
    return out


def _describe(size):
    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, "text"):
                sets = shingle_sets(part.column("text"), size)
                full = [i for i, s in enumerate(sets) if len(s)]
                node, sig = [None] * len(sets), [None] * len(sets)
                for i, row in zip(full, signatures([sets[i] for i in full]) if full else []):
                    node[i], sig[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), row.tobytes()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array([len(s) for s in sets], pa.int64()),
                                                  pa.array(node, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "key", "n", "node", "sig"])
    return run


def describe(docs: DataFrame, id_col="doc_id", text_col="text", size: int = SHINGLE) -> DataFrame:
    """(doc_id, key, n, node, sig) per row: the text's hash, the set's size, digest and signature."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("key"))
    return src.mapInArrow(_describe(size), f"doc_id {src.schema['doc_id'].dataType.simpleString()}, key long, n long, node binary, sig binary")


def chunk_keys(sigs: np.ndarray) -> np.ndarray:
    """For each signature the keys of its chunks, each symbol of a chunk left out in turn."""
    out = []
    for c in range(CHUNKS):
        symbols = sigs[:, c * CHUNK:(c + 1) * CHUNK].astype(np.int64)
        for left_out in range(CHUNK):
            key = np.full(len(sigs), c * CHUNK + left_out, np.int64)
            for s in range(CHUNK):
                if s != left_out:
                    key = key << 8 | symbols[:, s]
            out.append(key)
    return np.stack(out, axis=1)


def _keyed(batches):
    for batch in batches:
        sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(-1, SYMBOLS)
        keys = chunk_keys(sigs)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * keys.shape[1], pa.int32()), pa.array(keys.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), batch.column("sig"), lists], ["node", "n", "payload", "keys"])


def _spanning(n: np.ndarray, near) -> list[tuple[int, int]]:
    """A spanning forest of the links that ``near(i, rest)`` gives (a mask over rest)."""
    rest, out = np.arange(len(n)), []
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        frontier = [root]
        while frontier and len(rest):
            hit = near(frontier.pop(), rest)
            if hit.any():
                found, rest = rest[hit], rest[~hit]
                frontier.extend(found.tolist())
                out += [(int(root), int(x)) for x in found]
    return out


def by_signature(percent: int):
    """Candidate links of a group: signatures within the radius, sizes that allow a link."""
    def search(n, payload):
        sigs = np.frombuffer(b"".join(payload), np.uint8).reshape(len(n), -1)

        def near(i, rest):
            sizes = n[rest]
            return (100 * np.minimum(sizes, n[i]) >= percent * np.maximum(sizes, n[i])) & ((sigs[rest] != sigs[i]).sum(axis=1) <= RADIUS)
        return _spanning(n, near)
    return search


def by_sets(percent: int):
    """Links of a group: the full sets compared."""
    def search(n, payload):
        sets = [np.frombuffer(p, np.uint64) for p in payload]
        values = np.unique(np.concatenate(sets))
        codes = [np.searchsorted(values, s) for s in sets]
        mark = np.zeros(len(values), bool)

        def near(i, rest):
            sizes, hit = n[rest], np.zeros(len(rest), bool)
            fit = np.flatnonzero(100 * np.minimum(sizes, n[i]) >= percent * np.maximum(sizes, n[i]))
            if len(fit):
                mark[codes[i]] = True
                these = [codes[k] for k in rest[fit].tolist()]
                both = np.add.reduceat(mark[np.concatenate(these)], np.cumsum([0] + [len(c) for c in these[:-1]]), dtype=np.int64)
                mark[codes[i]] = False
                hit[fit] = 100 * both >= percent * (sizes[fit] + n[i] - both)
            return hit
        return _spanning(n, near)
    return search


GROUP_TYPES = {"bigint": pa.int64(), "binary": pa.binary()}


def _links(rows, pairs):
    return [(rows[a][1], rows[b][1]) for a, b in pairs if rows[a][1] != rows[b][1]]


def _batch(links, grp_type, again=()):
    """Links, and rows (grp, block, n, node, payload) that are to be dealt again."""
    cols = [[u for u, _ in links] + [None] * len(again), [v for _, v in links] + [None] * len(again)]
    for k in range(5):
        cols.append([None] * len(links) + [x[k] for x in again])
    types = [pa.binary(), pa.binary(), grp_type, pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["u", "v", "grp", "block", "n", "node", "payload"])


def _groups(search, weight, limit, grp_type):
    """Rows (grp, n, node, payload, first, last) in group and size order: links of the groups that
    lie whole in the partition and within a block; the others' rows come back with a block."""
    from pyspark import TaskContext

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        open_grp, held, load, cut, first = None, [], 0, False, True

        def close(ends):
            """Rows or links of the group that ends here."""
            nonlocal held, load, cut, block, first
            rows, held, load = held, [], 0
            split, cut = cut or first or ends, False
            first = False
            if split and rows:
                block += 1
                return _batch([], grp_type, [(open_grp, block, n, node, p) for n, node, p in rows])
            if len(rows) > 1:
                return _batch(_links(rows, search(np.array([r[0] for r in rows], np.int64), [r[2] for r in rows])), grp_type)

        for batch in batches:
            grps, n, node, payload = (batch.column(x) for x in ("grp", "n", "node", "payload"))
            sizes, rows = n.to_pylist(), batch.num_rows
            if not rows:
                continue
            starts = [0, *(1 + np.flatnonzero(pc.not_equal(grps.slice(1), grps.slice(0, rows - 1)).to_numpy(zero_copy_only=False))).tolist(), rows]
            for a, b in zip(starts, starts[1:]):
                if a and b - a == 1 and b < rows:
                    if open_grp is not None:  # what was open ends; a single row between two groups links nothing
                        out = close(False)
                        if out is not None:
                            yield out
                        open_grp = None
                    continue
                grp = grps[a].as_py()
                if grp != open_grp:
                    if open_grp is not None and (len(held) > 1 or first or cut):
                        out = close(False)
                        if out is not None:
                            yield out
                    open_grp, held, load = grp, [], 0
                nodes, payloads = node.slice(a, b - a).to_pylist(), payload.slice(a, b - a).to_pylist()
                for k in range(b - a):
                    w = weight(sizes[a + k])
                    if held and load + w > limit:
                        cut = True
                        block += 1
                        yield _batch([], grp_type, [(open_grp, block, x, y, z) for x, y, z in held])
                        held, load = [], 0
                    held.append((sizes[a + k], nodes[k], payloads[k]))
                    load += w
        if open_grp is not None:
            out = close(True)
            if out is not None:
                yield out
    return run


def _block_pairs(search, grp_type):
    """Rows (grp, a, b, n, node, payload) sorted by pair of blocks -> links."""
    def run(batches):
        open_pair, held = None, []
        for batch in batches:
            for *pair, n, node, payload in zip(*(batch.column(x).to_pylist() for x in ("grp", "a", "b", "n", "node", "payload"))):
                if pair != open_pair:
                    if len(held) > 1:
                        yield _batch(_links(held, search(np.array([r[0] for r in held], np.int64), [r[2] for r in held])), grp_type)
                    open_pair, held = pair, []
                held.append((n, node, payload))
        if len(held) > 1:
            yield _batch(_links(held, search(np.array([r[0] for r in held], np.int64), [r[2] for r in held])), grp_type)
    return run


def group_links(rows: DataFrame, search, weight, limit: int, percent: int, kind: str) -> DataFrame:
    """(u, v): a spanning forest of the links within the groups of ``rows`` (grp, n, node, payload)."""
    of, grp_type = rows.schema["grp"].dataType.simpleString(), GROUP_TYPES[rows.schema["grp"].dataType.simpleString()]
    link = f"u binary, v binary, grp {of}, block long, n long, node binary, payload binary"
    ordered = rows.select("grp", "n", "node", "payload").repartitionByRange("grp", "n", "node").sortWithinPartitions("grp", "n", "node")
    found = stage(ordered.mapInArrow(_groups(search, weight, limit, grp_type), link), kind)
    split = found.where("block is not null").select("grp", "block", "n", "node", "payload")
    blocks = split.groupBy("grp", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    a = blocks.select("grp", F.col("block").alias("a"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"))
    b = blocks.select("grp", F.col("block").alias("b"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
    fits = 100 * F.least("a_hi", "b_hi") >= percent * F.greatest("a_lo", "b_lo")
    pairs = a.join(b, "grp").where((F.col("a") <= F.col("b")) & fits)
    ends = pairs.select("grp", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    dealt = split.join(ends, ["grp", "block"]).select("grp", "a", "b", "n", "node", "payload")
    dealt = dealt.repartition("grp", "a", "b").sortWithinPartitions("grp", "a", "b")
    across = dealt.mapInArrow(_block_pairs(search, grp_type), link).select("u", "v")
    return found.where("block is null").select("u", "v").union(across)


def _sets(size):
    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, "text"):
                sets = shingle_sets(part.column("text"), size)
                yield part.drop_columns(["text"]).append_column("payload", pa.array([s.tobytes() for s in sets], pa.binary()))
    return run


def classes(docs: DataFrame, described: DataFrame, id_col="doc_id", text_col="text", percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """(node, component_id): the sets that have copies or links, with their component's least id."""
    nodes = stage(described.where("node is not null").groupBy("node").agg(
        F.first("n").alias("n"), F.first("sig").alias("sig"), F.min("doc_id").alias("first"), F.count("*").alias("copies"),
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("rep")), "nodes")
    keyed = nodes.select("node", "n", "sig").mapInArrow(_keyed, "node binary, n long, payload binary, keys array<long>")
    buckets = keyed.select(F.explode("keys").alias("grp"), "n", "node", "payload")
    candidates = components(group_links(buckets, by_signature(percent), lambda n: 1, BLOCK_NODES, percent, "buckets"))
    member = stage(candidates.union(candidates.select(F.col("root"), "root").distinct()).join(nodes, "node").select(
        F.col("root").alias("grp"), "n", "node", F.col("rep.doc_id").alias("rep_id"), F.col("rep.key").alias("rep_key")), "members")
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # one plan at every size: the texts meet their candidates by a sort-merge join
    texts = src.join(member.hint("merge"), src["doc_id"].eqNullSafe(member["rep_id"]) & (text_key(src["text"]) == member["rep_key"])).select("grp", "n", "node", "text")
    full = stage(texts.mapInArrow(_sets(size), "grp binary, n long, node binary, payload binary"), "full-sets")
    links = group_links(full, by_sets(percent), lambda n: n, BLOCK_HASHES, percent, "groups")
    roots = components(links)
    of = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first", "copies")
    least = of.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("copies").alias("rows"))
    return of.join(least.where("rows > 1"), "root").select("node", "component_id")


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    rows = stage(describe(docs, id_col, text_col, size), "sets")
    of = rows.select("doc_id", "n", "node").join(classes(docs, rows, id_col, text_col, percent, size).withColumn("linked", F.lit(True)), "node", "left")
    component = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("doc_id"))
    return of.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
