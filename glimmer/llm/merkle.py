"""A Merkle manifest of a dataset: a root for all rows, a subroot for each group, and each row's proof.

A row's leaf is the SHA-256 of its fields, each as its UTF-8 byte count, a colon and its value ("-" if null). Within a
group, leaves stand in ascending order of the key; every `arity` consecutive nodes become the digest of their
concatenated hex digests until one is left. Subroots, ordered by group (null first, bytewise), give the root alike.

Trees are built bottom up by events. A task keeps partial parents: for each, the digests of the children that have
arrived, by their index. How many a parent is due follows from the size of its level. When the last one arrives, the
parent is emitted and is itself an event for its own parent. What a task can't complete is its frontier, which meets
again by hash of an ancestor `stride` levels further up, until only tops are left. Rows arrive in ranges of the order, so
a frontier is a few nodes a level and task; that is what moves, and never a row.

Proofs go top down along reverse links: nodes of every stride-th level learn their proof from the node above them, at
most arity^stride to a task at a time, and at last the leaves do.

Keys may repeat (then the leaf's digest decides, equal rows in any order) and be null (such rows come last). Texts are
read once. Nothing of a group's size is ever held by one task or the driver, which learns the size of each range of rows.
An empty table has an empty manifest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glimmer.llm.common import arrow_schema, placed, quoted, ship, stage, to_batch, trim

#: Levels that one task climbs or descends at a time.
STRIDE = 10

NODE = "grp string, size long, level int, at long, digest binary, open boolean, fresh boolean"
LINK = "grp string, at long, size long, proof binary, subroot binary, root binary"


def leaf_digest(fields: Sequence[Column]) -> Column:
    """The SHA-256 of a row's fields, as 32 bytes."""
    parts = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def parent_digest(children: Iterable[bytes]) -> bytes:
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def width(size: int, level: int, arity: int) -> int:
    """The nodes of a level of a tree over so many leaves."""
    return -(-size // arity**level)


def depth(size: int, arity: int) -> int:
    """The level of the top."""
    level = 0
    while width(size, level, arity) > 1:
        level += 1
    return level


class Partials:
    """Partial parents by (group, level, index): their children's digests by index, until all that are due are there."""

    def __init__(self, arity: int) -> None:
        self.arity, self.open = arity, {}

    def add(self, grp: str, size: int, level: int, at: int, digest: bytes) -> Iterator[tuple[int, int, bytes]]:
        """A child arrives; yields (level, index, digest) of each ancestor that this completes."""
        while (there := width(size, level, self.arity)) > 1:
            parent = at // self.arity
            due = min(self.arity, there - parent * self.arity)
            children = self.open.setdefault((grp, size, level, parent), {})
            children[at % self.arity] = digest
            if len(children) < due:
                return
            del self.open[grp, size, level, parent]
            level, at, digest = level + 1, parent, parent_digest(children[i] for i in range(due))
            yield level, at, digest

    def frontier(self) -> Iterator[tuple[str, int, int, int, bytes]]:
        """The children of all parents that are not complete."""
        for (grp, size, level, parent), children in self.open.items():
            for i, digest in children.items():
                yield grp, size, level, parent * self.arity + i, digest


def climbed(nodes: DataFrame, arity: int, stride: int) -> DataFrame:
    """Nodes (grp, size, level, at, digest) combined in each task: the frontier (open), and of what was made here (fresh)
    every stride-th level and the tops; given tops come back as fresh too."""
    schema = arrow_schema(NODE)

    def combine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partials = Partials(arity)
        for batch in batches:
            out = []
            for grp, size, level, at, digest in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if width(size, level, arity) == 1:
                    out.append((grp, size, level, at, digest, False, True))
                for high, index, made in partials.add(grp, size, level, at, digest):
                    if high % stride == 0 or width(size, high, arity) == 1:
                        out.append((grp, size, high, index, made, False, True))
            yield to_batch(dict(zip(schema.names, map(list, zip(*out, strict=True)), strict=True)) if out else {n: [] for n in schema.names}, schema)
        rest = [(*x, True, False) for x in partials.frontier()]
        for start in range(0, len(rest), 4096):
            yield to_batch(dict(zip(schema.names, map(list, zip(*rest[start : start + 4096], strict=True)), strict=True)), schema)
        trim()

    return nodes.select("grp", "size", "level", "at", "digest").mapInArrow(combine, NODE)


def tree(leaves: DataFrame, arity: int, stride: int, most: int) -> DataFrame:
    """(grp, size, level, at, digest) of the nodes of every stride-th level above the leaves and of all tops; leaves: (grp,
    size, at, digest), of groups of at most `most`."""
    found = stage(climbed(leaves.withColumn("level", F.lit(0)), arity, stride), "merkle-nodes")
    made = [found.where("fresh")]
    top, high = depth(most, arity), 0
    while high < top:
        high += stride
        up = F.floor(F.col("at") / F.pow(F.lit(float(arity)), F.greatest(F.lit(high) - F.col("level"), F.lit(0)))).cast("long")
        found = stage(climbed(found.where("open").repartition("grp", up), arity, stride), "merkle-nodes")
        made.append(found.where("fresh"))
    out = made[0]
    for other in made[1:]:
        out = out.unionByName(other)
    return out.select("grp", "size", "level", "at", "digest")


def entry(run: Sequence[bytes], place: int) -> bytes:
    """One level of a proof: the place among its run, the run's length, and the other digests."""
    return bytes((place, len(run))) + b"".join(run[:place]) + b"".join(run[place + 1 :])


def levels(proof: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """(place, other digests) of each level of a proof, from the leaf up."""
    at = 0
    while at < len(proof):
        place, n = proof[at], proof[at + 1]
        at += 2
        yield place, [proof[i : i + 32] for i in range(at, at + 32 * (n - 1), 32)]
        at += 32 * (n - 1)


def local_proofs(digests: list[bytes], count: int, arity: int) -> list[bytes]:
    """Of consecutive nodes, the parts of their proofs that lead so many levels up."""
    proofs, spread = [b""] * len(digests), 1
    for _ in range(count):
        runs = [digests[i : i + arity] for i in range(0, len(digests), arity)]
        steps = [entry(run, k) for run in runs for k in range(len(run))]
        proofs = [p + steps[i // spread] for i, p in enumerate(proofs)]
        digests, spread = [parent_digest(run) for run in runs], spread * arity
    return proofs


def descended(children: DataFrame, above: DataFrame, level: int, arity: int, stride: int, carried: str = "") -> DataFrame:
    """(grp, at, size, proof, subroot, root, carried...) of the nodes (grp, at, size, digest, carried...) of a level, given
    the same of those `stride` levels up, or of their tops (at 0)."""
    block = arity**stride
    names = [x.split()[0] for x in carried.split(",")] if carried else []
    schema = arrow_schema(LINK + (f", {carried}" if carried else ""))
    own = children.select("grp", F.floor(F.col("at") / block).alias("block"), F.lit(1).alias("kind"), "at", "size", "digest", F.lit(None).cast("binary").alias("proof"), F.lit(None).cast("binary").alias("subroot"), F.lit(None).cast("binary").alias("root"), *names)
    up = above.select("grp", F.col("at").alias("block"), F.lit(0).alias("kind"), "at", "size", F.lit(None).cast("binary").alias("digest"), "proof", "subroot", "root")
    both = own.unionByName(up, allowMissingColumns=True)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for _, group in groupby(rows, key=lambda r: (r[0], r[1])):
            head, *nodes = group
            if not nodes:
                continue
            grp, size, proof, subroot, root = head[0], head[4], head[6], head[7], head[8]
            local = local_proofs([r[5] for r in nodes], min(stride, depth(size, arity) - level), arity)
            n = len(nodes)
            columns = {"grp": [grp] * n, "at": [r[3] for r in nodes], "size": [size] * n, "proof": [x + proof for x in local], "subroot": [subroot] * n, "root": [root] * n}
            columns |= {name: [r[9 + i] for r in nodes] for i, name in enumerate(names)}
            yield to_batch(columns, schema)
        trim()

    dealt = both.repartition("grp", "block").sortWithinPartitions("grp", "block", "kind", "at")
    return dealt.mapInArrow(run, LINK + (f", {carried}" if carried else ""))


def proofs(leaves: DataFrame, nodes: DataFrame, tops: DataFrame, most: int, arity: int, stride: int, carried: str) -> DataFrame:
    """The links (with carried columns) of the leaves, from those of the tops, level by level."""
    starts = list(range(0, max(1, depth(most, arity)), stride))
    above = tops
    for level in reversed(starts):
        inner = F.col("size") > arity**level if level else F.lit(True)
        given = leaves if level == 0 else nodes.where((F.col("level") == level) & inner)
        # a node's parent here is its group's top, or one that the last step gave
        parents = tops.where(F.col("size") <= arity ** (level + stride))
        if level + stride in starts:
            parents = parents.unionByName(above.where(F.col("size") > arity ** (level + stride)))
        above = descended(given, parents, level, arity, stride, "" if level else carried)
        if level:
            above = stage(above, "merkle-links")
    return above


def sized(ordered: DataFrame) -> tuple[DataFrame, int]:
    """Rows (grp, place, ...) in a strict order in which groups are contiguous, with `at`, the index in the group, and its
    size; and the largest size."""
    sizes = stage(ordered.groupBy("grp").agg(F.min("place").alias("start"), F.count("*").alias("size")), "merkle-sizes")
    most = sizes.agg(F.max("size")).first()[0] or 0
    return ordered.join(sizes, "grp").withColumn("at", F.col("place") - F.col("start")).drop("start", "place"), most


def manifest(docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang", key: str = "doc_id", other: Sequence[Column] | None = None, arity: int = 2, stride: int = STRIDE) -> DataFrame:
    """(key, group, leaf, subroot, root, proof, other) of each row: 32-byte digests, and the proof as read by levels().
    other: fields of a second leaf for each row, which is no part of the trees. key: long; reads the columns named only."""
    if not 2 <= arity <= 255:
        raise ValueError("a parent has 2 to 255 children")
    ship(docs.sparkSession)
    second = leaf_digest(other) if other is not None else F.lit(None).cast("binary")
    named = F.coalesce(F.concat(F.lit("="), F.col(quoted(group)).cast("string")), F.lit(""))  # null first, then bytewise
    rows = docs.select(F.col(quoted(key)).cast("long").alias("id"), named.alias("grp"), leaf_digest([F.col(quoted(f)) for f in fields]).alias("digest"), second.alias("other"))
    rows = stage(rows, "merkle-leaves")
    leaves, most = sized(placed(rows, [F.col("grp"), F.col("id").asc_nulls_last(), F.col("digest")]))
    nodes = tree(leaves, arity, stride, most)
    top = F.col("size") <= F.pow(F.lit(float(arity)), F.col("level"))
    tops = stage(nodes.where(top).select("grp", "size", "digest"), "merkle-tops")

    upper, n_groups = sized(placed(tops.select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("size").alias("held"), "digest"), [F.col("grp"), F.col("name")]))
    upper_nodes = tree(upper, arity, stride, n_groups)
    root = upper_nodes.where(top).select("grp", F.lit(0).cast("long").alias("at"), "size", F.lit(b"").alias("proof"), F.lit(None).cast("binary").alias("subroot"), F.col("digest").alias("root"))
    linked = proofs(upper.withColumn("top", F.col("digest")), upper_nodes, stage(root, "merkle-root"), n_groups, arity, stride, "name string, held long, top binary")
    links = stage(linked.select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("at"), F.col("held").alias("size"), "proof", F.col("top").alias("subroot"), "root"), "merkle-links")

    found = proofs(leaves.withColumn("leaf", F.col("digest")), nodes, links, most, arity, stride, "id long, leaf binary, other binary")
    return found.select(F.col("id").alias(key), F.when(F.col("grp") != "", F.expr("substring(grp, 2)")).alias(group), "leaf", "subroot", "root", "proof", "other")


def folded(df: DataFrame, start: str, proof: str = "proof") -> DataFrame:
    """df (of plain columns) with folded_root, which the digest in start and the proof lead to, and proof_sha256, of the
    proof's digests as hex text from the leaf up; 32 bytes each. A null start is folded to null."""
    names = df.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots, hashes = [], []
            for digest, way in zip(batch.column(names.index(start)).to_pylist(), batch.column(names.index(proof)).to_pylist(), strict=True):
                seen = hashlib.sha256()
                for place, others in levels(way):
                    for x in others:
                        seen.update(x.hex().encode())
                    digest = digest and parent_digest([*others[:place], digest, *others[place:]])
                roots.append(digest)
                hashes.append(seen.digest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, type=pa.binary()), pa.array(hashes, type=pa.binary())], names=[*names, "folded_root", "proof_sha256"])

    from pyspark.sql.types import BinaryType, StructType

    return df.mapInArrow(run, StructType([*df.schema.fields]).add("folded_root", BinaryType()).add("proof_sha256", BinaryType()))
