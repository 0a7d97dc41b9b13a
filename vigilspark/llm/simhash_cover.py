"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints of 64 bits are linked at ``radius`` or fewer differing bits.  The
tables are structured: bit i carries a nonzero vector m(i) over GF(2) of
``radius`` + 1 dimensions, and table v (2^(radius+1) - 1 of them) keeps the bits
with <m(i), v> = 1.  The vectors of any ``radius`` bits leave some v orthogonal
to all of them, so two fingerprints that differ in them agree on all bits that
table v keeps: every pair within the radius meets in some table, surely.

Equal fingerprints are one node.  A bucket of at most ``BUCKET`` nodes is searched
in its task and gives a spanning tree of its links (never all pairs); a larger
one is dealt again by the same construction on the bits its table left out,
which loses no pair and keeps at least one bit more, until the remaining bits
leave at most ``BUCKET`` values.

Defined cases: a text without words (null, empty) has fingerprint zero and is
linked like any other; repeated rows give a row each; rows without an id take
part, and a component of such rows alone has a null component_id; other columns
are ignored (``deduplicate`` keeps them).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, carried, stage, text_key, unpacked
from .components import components
from .words import split_words

SHINGLE, RADIUS, SEED, BITS = 4, 4, 42, 64
BUCKET = 4096


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the 64-bit hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        block = np.ascontiguousarray(hashes[k:k + (1 << 16)]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def shingle_hashes(joined: bytes, lengths: np.ndarray, size: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of the windows of ``size`` words of space-joined ``joined``."""
    n = len(lengths)
    if not n:
        return np.zeros(0, np.uint64)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    of = xxhash.xxh64_intdigest
    if n < size:
        return np.array([of(joined, seed)], np.uint64)
    return np.array([of(joined[a:b], seed) for a, b in zip(starts, ends[size - 1:].tolist())], np.uint64)


def _fingerprints(size):
    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, "text"):
                w = split_words(part.column("text"))
                words = w.words.take(pa.array(w.codes))
                lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
                at = w.offsets
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), words), " ").cast(pa.binary()).to_pylist()
                prints = [fingerprint(shingle_hashes(joined[i], lengths[at[i]:at[i + 1]], size)) for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(np.array(prints, np.uint64).view(np.int64))], ["doc_id", "key", "fp"])
    return run


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, key, fp) per row; fp is the fingerprint as a signed long, key the text's hash."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("key"))
    return src.mapInArrow(_fingerprints(shingle), f"doc_id {src.schema['doc_id'].dataType.simpleString()}, key long, fp long")


def masks(radius: int, free: int = (1 << BITS) - 1) -> list[int]:
    """The covering masks over the set bits of ``free``; bits outside are kept by all."""
    dims = (1 << (radius + 1)) - 1
    bits = [i for i in range(BITS) if free >> i & 1]
    # a basis first: with more than radius bits the vectors span the space, so every mask keeps one of them
    basis = [1 << d for d in range(radius + 1)]
    vectors = basis + [v for v in range(dims, 0, -1) if v not in basis]
    kept = ((1 << BITS) - 1) & ~free
    return [kept | sum(1 << b for k, b in enumerate(bits) if (v & vectors[k % dims]).bit_count() & 1) for v in range(1, dims + 1)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def bucket_links(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning tree (root, node) of each component of the links among distinct
    fingerprints; memory and output grow with their number."""
    left, out = prints.view(np.uint64), []
    while len(left) > 1:
        root, left = left[0], left[1:]
        frontier = [root]
        while frontier and len(left):
            near = np.bitwise_count(left ^ frontier.pop()) <= radius
            if near.any():
                found = left[near]
                left = left[~near]
                frontier.extend(found)
                out += [(root, x) for x in found]
    return out


def _buckets(radius, most):
    """Rows (table, key, fp) sorted by table and key -> links; rows of buckets
    with more than ``most`` fingerprints go on with their table."""
    def pack(links, again):
        u = np.array([a for a, _ in links] + [f for _, f in again], np.uint64).view(np.int64)
        v = np.array([b for _, b in links] + [f for _, f in again], np.uint64).view(np.int64)
        t = pa.array([None] * len(links) + [t for t, _ in again], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), t], ["u", "v", "again"])

    def run(batches):
        open_table = open_key = None
        held, large = np.zeros(0, np.int64), False  # the bucket that goes on with the next batch
        for batch in batches:
            t, k, f = (batch.column(x).to_numpy() for x in ("table", "key", "fp"))
            cut = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
            bounds = [0, *cut.tolist(), len(t)] if len(t) else [0]
            links, again = [], []
            for a, b in zip(bounds, bounds[1:]):
                if (t[a], k[a]) != (open_table, open_key):
                    if not large and len(held) > 1:
                        links += bucket_links(held, radius)
                    open_table, open_key, held, large = t[a], k[a], np.zeros(0, np.int64), False
                new = f[a:b]
                if not large and len(held) + len(new) > most:
                    large = True
                    again += [(open_table, x) for x in held.view(np.uint64)]
                if large:
                    again += [(open_table, x) for x in new.view(np.uint64)]
                    held = np.zeros(0, np.int64)
                else:
                    held = np.concatenate([held, new])
            yield pack(links, again)
        if not large and len(held) > 1:
            yield pack(bucket_links(held, radius), [])
    return run


def links(nodes: DataFrame, radius: int = RADIUS, most: int = BUCKET) -> DataFrame:
    """(u, v): links that connect what any links within the radius connect, from
    distinct fingerprints (fp)."""
    spark, found = nodes.sparkSession, None
    most = max(most, 1 << radius)  # with radius free bits or fewer all values are linked: nothing to deal
    tables = {i: (m, ((1 << BITS) - 1) & ~m) for i, m in enumerate(masks(radius))}
    rows = nodes.select("fp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(tables) - 1).cast("long"))).alias("table"))
    while True:
        rows = rows.join(F.broadcast(spark.createDataFrame([(i, _signed(m)) for i, (m, _) in tables.items()], "table long, mask long")), "table")
        dealt = rows.select("table", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp").repartition("table", "key").sortWithinPartitions("table", "key")
        got = stage(dealt.mapInArrow(_buckets(radius, most), "u long, v long, again long"), "links")
        own = got.where("again is null").select("u", "v")
        found = own if found is None else found.union(own)
        hot = got.where("again is not null").select(F.col("u").alias("fp"), F.col("again").alias("parent"))
        parents = [x[0] for x in hot.select("parent").distinct().collect()]  # tables, not rows: at most their number
        parents = [p for p in parents if tables[p][1]]
        if not parents:
            return found
        deeper, pairs = {}, []
        for p in parents:
            for m in masks(radius, tables[p][1]):
                deeper[len(deeper)] = (m, ((1 << BITS) - 1) & ~m)
                pairs.append((p, len(deeper) - 1))
        tables = deeper
        rows = hot.join(F.broadcast(spark.createDataFrame(pairs, "parent long, table long")), "parent").select("fp", "table")


def classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root, component_id) of the distinct fingerprints of ``prints``."""
    nodes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = components(links(nodes.select("fp"), radius))
    of = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    least = of.groupBy("root").agg(F.min("first").alias("component_id"))
    return of.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id."""
    prints = stage(fingerprints(docs, id_col, text_col, shingle), "prints")
    return prints.join(classes(prints, radius), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col="doc_id", text_col="text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each component (least id, then least text key), all columns."""
    prints = stage(fingerprints(docs, id_col, text_col, shingle), "prints")
    member = prints.join(classes(prints, radius).select("fp", "root"), "fp")
    keep = member.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("k")).select("k.doc_id", "k.key")
    d = carried(docs, text_col)
    d = d.select("row", "text", F.col("row")[id_col].alias("id"), text_key(F.col("text")).alias("text_key"))
    kept = d.join(keep, d["id"].eqNullSafe(keep["doc_id"]) & (d["text_key"] == keep["key"]), "left_semi")
    # of rows with equal id and text the first
    first = Window.partitionBy("id", "text_key").orderBy(F.lit(1))
    return unpacked(kept.withColumn("nth", F.row_number().over(first)).where("nth = 1"), docs, text_col)
