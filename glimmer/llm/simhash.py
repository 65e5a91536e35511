"""SimHash near-duplicates by a hierarchical index in Gray order.

Fingerprints are made in one pass. Equal ones fall together first, so what follows works on distinct fingerprints.
The index has three kinds of nodes. Its upper nodes are masked bit patterns: of four 16-bit segments two are kept, in
each of six ways; two fingerprints that differ in two bits or fewer agree on two segments, so they meet below at least
one pattern. A pattern with many fingerprints is split once more by the same rule on its other 32 bits, after which at
most 2^16 distinct ones can share a pattern. Below a pattern, fingerprints are sorted by Gray rank; consecutive ones
form groups, groups of groups, and so on, and the bits that all agree on are factored into the group's node. A search
adds up differences from the top and leaves a whole group as soon as they exceed the limit.

Links are not listed: each pattern joins what its searches link and passes on one row for each member. Components
follow from these rows by rounds of star contraction. Nothing is collected to the driver.

Links and components name fingerprints; only at the end each component gets its smallest identifier. Texts without words
have fingerprint zero. Rows with a null identifier take part; they rank after all others, and a component of nothing else
has a null identifier.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import combinations, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.llm.common import documents, ship, slices, stage, to_batch

SEED = 42
#: Patterns with more fingerprints than this are split again.
MANY = 2048
#: Children of a node.
FAN = 8
#: Queries that are searched together.
TOGETHER = 1024
#: Texts of more bytes are cut into words piece by piece.
LONG = 1 << 20

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: A byte's bits, the lowest in the lowest of eight lanes.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").reshape(-1).view(np.uint64).copy()


def word_runs(text: bytes, size: int, most: int = 1 << 16) -> Iterator[list[bytes]]:
    """The words, in runs that overlap by size - 1 words."""
    if len(text) <= LONG:
        yield text.split()
        return
    found, kept = (m.group() for m in WORD.finditer(text)), []
    while more := list(islice(found, most)):
        kept = kept[len(kept) - (size - 1) :] + more if kept else more
        yield kept


def fingerprint(text: bytes, size: int = 3) -> int:
    """The SimHash of the text's shingles of so many words, each as often as it occurs; fewer words are one shingle."""
    import xxhash

    counts, total, first = np.zeros(64, dtype=np.int64), 0, None
    for words in word_runs(text.lower(), size):
        if len(words) < size:
            first = b" ".join(words) if words else None
            continue
        first = None
        shingles = words if size == 1 else map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64, count=len(words) - size + 1)
        total += len(hashes)
        lanes = LANES[hashes.view(np.uint8)].reshape(-1, 8)
        for start in range(0, len(lanes), 255 * 256):
            part = lanes[start : start + 255 * 256]
            whole = len(part) // 255 * 255
            if whole:
                counts += part[:whole].reshape(-1, 255, 8).sum(axis=1).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
            if whole < len(part):
                counts += part[whole:].sum(axis=0).view(np.uint8).astype(np.int64)
    if not total:
        return xxhash.xxh64_intdigest(first, SEED) if first else 0
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, fp): fp is the fingerprint's bits as a signed long."""
    schema = pa.schema([("doc", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(x, size) for x in batch.column(1).cast(pa.binary()).to_pylist()], dtype=np.uint64)
            yield to_batch({"doc": batch.column(0), "fp": pa.array(found.view(np.int64))}, schema)

    return documents(docs, key, text).mapInArrow(run, "doc long, fp long")


def gray_rank(fp: F.Column) -> F.Column:
    """The place of fp among all Gray codes."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def masks(bits: list[int], parts: int = 4) -> list[int]:
    """The masks that keep two of the parts into which the given bits fall."""
    each = len(bits) // parts
    segments = [sum(1 << b for b in bits[i * each : (i + 1) * each]) for i in range(parts)]
    return [a | b for a, b in combinations(segments, 2)]


UPPER = masks(list(range(64)))
#: Of each upper mask, those of the next level: they keep its bits too.
LOWER = {m: [m | x for x in masks([b for b in range(64) if not m >> b & 1])] for m in UPPER}


def below_masks(df: DataFrame, kept: list[tuple[int, int]]) -> DataFrame:
    """Each row below each (node, mask): columns node, value, fp, rep."""
    nodes = F.explode(F.array(*(F.struct(F.lit(node).alias("node"), F.col("fp").bitwiseAND(F.lit(signed(mask))).alias("value")) for node, mask in kept)))
    return df.select("fp", "rep", nodes.alias("at")).select("at.node", "at.value", "fp", "rep")


def joined(n: int, a: np.ndarray, b: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """parent, the least member of each component, after links a-b."""
    while a.size:
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        apart = low != high
        if not apart.any():
            break
        a, b, low, high = a[apart], b[apart], low[apart], high[apart]
        np.minimum.at(parent, high, low)
        while (parent[parent] != parent).any():
            parent = parent[parent]
    return parent


def tree(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(pattern, mask) of the nodes of each level, leaves first; codes are in Gray order."""
    levels = [(codes, np.full(len(codes), ~np.uint64(0)))]
    while len(levels[-1][0]) > FAN:
        pattern, mask = levels[-1]
        starts = np.arange(0, len(pattern), FAN)
        first = np.repeat(pattern[starts], FAN)[: len(pattern)]
        agreed = np.bitwise_and.reduceat(mask & ~(pattern ^ first), starts)
        levels.append((pattern[starts] & agreed, agreed))
    return levels


def search(codes: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions, the first below the second, whose codes differ in at most so many bits."""
    levels = tree(codes)
    top = len(levels[-1][0])
    for start in range(0, len(codes), TOGETHER):
        own = np.arange(start, min(start + TOGETHER, len(codes)))
        query, node = np.repeat(own, top), np.tile(np.arange(top), len(own))
        spent, above = np.zeros(len(query), dtype=np.uint8), np.zeros(len(query), dtype=np.uint64)
        for depth in range(len(levels) - 1, -1, -1):
            pattern, mask = levels[depth]
            spent = spent + np.bitwise_count((codes[query] ^ pattern[node]) & mask[node] & ~above)
            keep = (spent <= most) & ((node + 1) * FAN**depth > query)  # only what lies behind the query
            query, node, spent = query[keep], node[keep], spent[keep]
            if not depth:
                keep = node > query
                yield query[keep], node[keep]
                break
            above = np.repeat(mask[node], FAN)
            query, spent = np.repeat(query, FAN), np.repeat(spent, FAN)
            node = (node[:, None] * FAN + np.arange(FAN)).reshape(-1)
            there = node < len(levels[depth - 1][0])
            query, node, spent, above = query[there], node[there], spent[there], above[there]


def members(codes: np.ndarray, reps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the codes below a pattern, in Gray order: (member, least member) of those that links join."""
    parent = np.arange(len(codes))
    order = np.argsort(reps, kind="stable")  # so that the least position is the least representative
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    for a, b in search(codes, most):
        parent = joined(len(codes), rank[a], rank[b], parent)
    moved = np.flatnonzero(parent != np.arange(len(parent)))
    return reps[order[moved]], reps[order[parent[moved]]]


def local_links(df: DataFrame, most: int) -> DataFrame:
    """(a, b) with b < a from rows (node, value, fp, rep), for each pattern apart."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def close(rows: list[np.ndarray]) -> pa.RecordBatch:
            node, value, fp, rep = rows
            edge = np.flatnonzero((node[1:] != node[:-1]) | (value[1:] != value[:-1])) + 1
            starts, stops = np.r_[0, edge], np.r_[edge, len(node)]
            many = np.flatnonzero(stops - starts > 1)
            out = [members(fp[s:t].view(np.uint64), rep[s:t], most) for s, t in zip(starts[many].tolist(), stops[many].tolist(), strict=True)]
            a = np.concatenate([x for x, _ in out]) if out else np.zeros(0, dtype=np.int64)
            b = np.concatenate([x for _, x in out]) if out else np.zeros(0, dtype=np.int64)
            return to_batch({"a": a, "b": b}, schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
            node, value = held[0], held[1]
            same = (node == node[-1]) & (value == value[-1])  # the last pattern may go on
            cut = len(node) - int(same[::-1].argmin()) if not same.all() else 0
            if cut:
                yield close([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held:
            yield close(held)

    ordered = df.repartition("node", "value").withColumn("rank", gray_rank(F.col("fp"))).sortWithinPartitions("node", "value", "rank")
    return ordered.select("node", "value", "fp", "rep").mapInArrow(run, "a long, b long")


def contract(links: DataFrame) -> DataFrame:
    """(a, b): b is the least member of a's component; least members themselves are left out. Rounds of large and
    small stars, each written out, until nothing changes."""

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = mark(now)
    while seen[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        now = stage(small.where("a <> b").distinct(), "links")
        was, seen = seen, mark(now)
        if was == seen:
            break
    return now


def near_duplicates(docs: DataFrame, most_bits: int = 2, size: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row: documents link if their fingerprints differ in at most
    most_bits (two at most); the component's identifier is the smallest in it."""
    if not 0 <= most_bits <= 2:
        raise ValueError("the patterns find links of at most two bits")
    ship(docs.sparkSession)
    own = stage(fingerprints(docs, size, key, text), "fingerprints")
    classes = stage(own.groupBy("fp").agg(F.min("doc").alias("first")).withColumn("rep", F.col("fp")), "classes")
    upper = below_masks(classes.select("fp", "rep"), list(enumerate(UPPER)))
    many = stage(upper.groupBy("node", "value").count().where(F.col("count") > MANY).select("node", "value"), "patterns")
    links = local_links(upper.join(many, ["node", "value"], "left_anti"), most_bits)
    crowded = upper.join(many, ["node", "value"], "left_semi")
    for i, mask in enumerate(UPPER):
        finer = below_masks(crowded.where(F.col("node") == i), [(6 + 6 * i + j, m) for j, m in enumerate(LOWER[mask])])
        deeper = finer if i == 0 else deeper.unionByName(finer)
    links = links.unionByName(local_links(deeper, most_bits))
    least = contract(links)
    named = classes.join(least, classes["rep"] == least["a"], "left").select("fp", "first", F.coalesce("b", "rep").alias("class"))
    smallest = named.groupBy("class").agg(F.min("first").alias("component_id"))
    found = own.join(named.join(smallest, "class").select("fp", "component_id"), "fp")
    return found.select(F.col("doc").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
