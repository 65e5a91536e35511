"""Near-copies by the exact Jaccard similarity of word shingles.

A set is the 64-bit hashes of the text's shingles of so many words. Two sets of similarity 4/5 share at least four
fifths of either, so when both are put into one order, each has its first l shared items among its first
n - ceil(4n/5) + l items. This is used twice, and neither loses a pair:

* In the order of the hashes with l = n/10: a text whose head holds too few items that other heads hold has no partner.
  Only heads are moved, dealt by ranges of hashes. Of an item, or a set, that several texts of a slice hold, one row goes
  out for the slice, so what many texts share never meets as a row a text.
* Among the texts that are left, from the rarest item to the most frequent one, with l = 1: texts that share an item of
  their heads are candidates. The most frequent items (at most MOST_HOT by their count) come last in the order and are not
  dealt by their hashes.

The texts with an item in their heads are its list. Candidates are compared along lists, and only while two components of
links meet in one: first all texts of a list with its centre (the text most of whose head others share), in STARS rounds;
then, in lists that still hold several components, all pairs, those of at most SHORT texts one by one, those of longer
lists in blocks, each pair of blocks in one group. Nothing is collected to the driver but counts and the most frequent
items. Equal sets are linked at once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.llm.common import count_blocks, ship, slices, stage, to_batch
from glimmer.llm.simhash import SEED, contract, joined, word_runs

#: Texts of a long list's component in one block.
MOST = 1024
#: Rounds in which lists are compared with their centres, and texts of a list whose pairs are compared one by one after.
STARS, SHORT = 2, 32
#: Items that count as the most frequent ones at most: those that make up more than this part of all.
MOST_HOT = 1 << 17
#: Bytes of text whose heads, or whose sets, make up a range of hashes.
RANGE_BYTES = 16 << 20

DEALT = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])
DEALT_DDL = "part int, kind int, a binary, b binary, c binary, d binary"


def shingle_set(text: bytes, size: int = 5) -> np.ndarray:
    """The distinct hashes, ascending; fewer words than size are one shingle."""
    import xxhash

    found, first = [], b""
    for words in word_runs(text.lower(), size):
        if len(words) < size:
            first = b" ".join(words)
            continue
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
        found.append(np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64, count=len(words) - size + 1)))
    if not found:
        return np.array([xxhash.xxh64_intdigest(first, SEED)], dtype=np.uint64)
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def overlap(n: int) -> int:
    """What a set of n items shares at least with any partner; no partner is smaller."""
    return -(-4 * n // 5)


def more(n: int) -> int:
    """Shared items that the heads of a first pass are to hold."""
    return max(1, n // 10)


def ranges(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The range of each hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def cut(kind: int, part: np.ndarray, arrays: list[np.ndarray]) -> Iterator[dict]:
    """The arrays by range, packed."""
    order = np.argsort(part, kind="stable")
    part, arrays = part[order], [x[order] for x in arrays]
    edges = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)].tolist() if len(part) else []
    for s, t in zip(edges, edges[1:], strict=False):
        yield {"part": int(part[s]), "kind": kind, **{name: x[s:t].tobytes() for name, x in zip("abcd", [*arrays, *[part[:0]] * (4 - len(arrays))], strict=True)}}


def gathered(rows: pa.Table, kind: int, dtypes: list) -> list[np.ndarray]:
    """The arrays of a range."""
    own = rows.filter(pc.equal(rows["kind"], kind))
    return [np.frombuffer(b"".join(own[name].to_pylist()), dtype=d) for name, d in zip("abcd", dtypes, strict=False)]


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, length) of the runs of equal values."""
    starts = np.r_[0, np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1] if len(sorted_values) else np.zeros(0, dtype=np.int64)
    return starts, np.diff(np.r_[starts, len(sorted_values)])


def heads(plain: DataFrame, parts: int, size: int) -> DataFrame:
    """(key, rep, need, found): rows of the equal sets' least key, of what heads must share, of what they share."""
    import xxhash

    out_schema = pa.schema([("key", pa.int64()), ("rep", pa.int64()), ("need", pa.int64()), ("found", pa.int64())])
    none = lambda n: pa.nulls(n, pa.int64())

    def answers(rows: tuple[np.ndarray, ...]) -> Iterator[tuple]:
        """Rows of texts whose set another one represents, and of shared items."""
        apart, rep, shared, times = rows
        yield pa.array(apart), pa.array(rep), none(len(apart)), none(len(apart))
        yield pa.array(shared), none(len(shared)), none(len(shared)), pa.array(times)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, at = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_index=True)
            blobs = batch.column(1).cast(pa.binary())
            sets = [shingle_set(blobs[i].as_py(), size) for i in at.tolist()]
            digests = np.array([[d >> 64, d & (1 << 64) - 1] for d in (xxhash.xxh128_intdigest(x.tobytes(), SEED) for x in sets)], dtype=np.uint64)
            _, first, back = np.unique(digests, axis=0, return_index=True, return_inverse=True)
            rep = keys[first][back.ravel()]  # keys ascend, so a set's first is its least
            own = np.sort(first)
            need = np.array([more(overlap(len(sets[i]))) for i in own], dtype=np.int64)
            own_heads = [sets[i][: len(sets[i]) - overlap(len(sets[i])) + more(len(sets[i]))] for i in own.tolist()]
            flat, owner = np.concatenate(own_heads), np.repeat(keys[own], [len(x) for x in own_heads])
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            starts, lengths = runs(flat)
            many = np.repeat(lengths > 1, lengths)
            shared, times = np.unique(owner[many], return_counts=True)
            alone, once = ~many, starts[lengths > 1]
            part = np.r_[flat[alone], flat[once]]
            weight = np.r_[np.ones(int(alone.sum()), dtype=np.int64), np.full(len(once), 2)]
            rows = [*cut(0, ranges(digests[own, 0], parts), [keys[own], digests[own, 0], digests[own, 1], need]), *cut(1, ranges(part, parts), [np.r_[owner[alone], owner[once]], part, weight])]
            apart = np.flatnonzero(rep != keys)
            rows += [{"part": int(ranges(keys[:1].view(np.uint64), parts)[0]), "kind": 2, "a": keys[apart].tobytes(), "b": rep[apart].tobytes(), "c": shared.tobytes(), "d": times.astype(np.int64).tobytes()}]
            yield pa.RecordBatch.from_pylist(rows, schema=DEALT)

    def count(rows: pa.Table) -> pa.Table:
        keys, high, low, need = gathered(rows, 0, [np.int64, np.uint64, np.uint64, np.int64])
        order = np.lexsort((keys, low, high))
        keys, need, same = keys[order], need[order], np.r_[False, (high[order][1:] == high[order][:-1]) & (low[order][1:] == low[order][:-1])] if len(order) else np.zeros(0, dtype=bool)
        rep = keys[np.maximum.accumulate(np.where(same, 0, np.arange(len(keys))))] if len(keys) else keys
        apart = rep != keys
        docs, items, weights = gathered(rows, 1, [np.int64, np.uint64, np.int64])
        order = np.lexsort((docs, items))
        docs, items, weights = docs[order], items[order], weights[order]
        again = np.r_[False, (items[1:] == items[:-1]) & (docs[1:] == docs[:-1])] if len(order) else np.zeros(0, dtype=bool)
        starts, lengths = runs(items)
        total = np.add.reduceat(np.where(again & (weights == 1), 0, weights), starts) if len(starts) else lengths
        shared, times = np.unique(docs[np.repeat(total > 1, lengths) & (weights == 1) & ~again], return_counts=True)
        got = [(pa.array(keys[~same]), none(int((~same).sum())), pa.array(need[~same]), none(int((~same).sum())))]
        got += answers((keys[apart], rep[apart], shared, times.astype(np.int64)))
        got += answers(tuple(gathered(rows, 2, [np.int64] * 4)))
        return pa.table([pa.concat_arrays(list(x)) for x in zip(*got, strict=True)], schema=out_schema)

    return plain.mapInArrow(deal, DEALT_DDL).repartition(parts, "part").groupBy("part").applyInArrow(count, "key long, rep long, need long, found long")


def split_sets(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(key, item) of all sets of a batch (key, items)."""
    own = [np.frombuffer(x, dtype=np.uint64) for x in batch.column(1).to_pylist()]
    return np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(x) for x in own]), np.concatenate(own)


def frequent(sets: DataFrame, parts: int, most: int) -> np.ndarray:
    """The items in over one of `most` places of all sets, so fewer than that; ascending. Counted in each batch first."""

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                items, times = np.unique(split_sets(batch)[1], return_counts=True)
                yield pa.RecordBatch.from_pylist(list(cut(0, ranges(items, parts), [items, times.astype(np.int64)])), schema=DEALT)

    total = sets.agg(F.sum(F.octet_length("items"))).first()[0] or 0
    least = max(2, total // 8 // most)

    def count(rows: pa.Table) -> pa.Table:
        items, times = gathered(rows, 0, [np.uint64, np.int64])
        order = np.argsort(items, kind="stable")
        starts, _ = runs(items[order])
        sums = np.add.reduceat(times[order], starts) if len(starts) else starts
        return pa.table({"item": pa.array(items[order][starts[sums > least]].view(np.int64))})

    found = sets.mapInArrow(deal, DEALT_DDL).repartition(parts, "part").groupBy("part").applyInArrow(count, "item long").toArrow()
    return np.sort(found["item"].to_numpy().view(np.uint64))


def rare_items(sets: DataFrame, parts: int, hot: np.ndarray) -> DataFrame:
    """(item, key): the shared items in the head of each set, from the rarest item on; those of hot are the last."""

    def dealer(of_hot: bool):
        def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    keys, flat = split_sets(batch)
                    at = np.minimum(np.searchsorted(hot, flat), max(0, len(hot) - 1))
                    mine = (hot[at] == flat if len(hot) else np.zeros(len(flat), dtype=bool)) == of_hot
                    keys, flat = keys[mine], flat[mine]
                    if of_hot:  # they are known to be shared, and go to their texts at once
                        rows = cut(0, ranges(keys.view(np.uint64), parts), [keys, flat, np.full(len(keys), 1 << 62, dtype=np.int64)])
                    else:
                        rows = cut(0, ranges(flat, parts), [keys, flat])
                    yield pa.RecordBatch.from_pylist(list(rows), schema=DEALT)

        return deal

    def count(rows: pa.Table) -> pa.Table:
        docs, items = gathered(rows, 0, [np.int64, np.uint64])
        order = np.argsort(items, kind="stable")
        starts, lengths = runs(items[order])
        times = np.repeat(lengths, lengths)
        docs, items = docs[order], items[order]
        back = list(cut(0, ranges(docs.view(np.uint64), parts), [docs, items, times.astype(np.int64)]))
        return pa.Table.from_pylist(back, schema=DEALT)

    def head(rows: pa.Table) -> pa.Table:
        docs, items, times = gathered(rows, 0, [np.int64, np.uint64, np.int64])
        order = np.lexsort((items, times, docs))
        docs, items, times = docs[order], items[order], times[order]
        starts, lengths = runs(docs)
        place = np.arange(len(docs)) - np.repeat(starts, lengths)
        keep = (place < np.repeat(lengths - -(-4 * lengths // 5) + 1, lengths)) & (times > 1)
        return pa.table({"item": pa.array(items[keep].view(np.int64)), "key": pa.array(docs[keep])})

    counted = sets.mapInArrow(dealer(False), DEALT_DDL).repartition(parts, "part").groupBy("part").applyInArrow(count, DEALT_DDL)
    both = counted.unionByName(sets.mapInArrow(dealer(True), DEALT_DDL))
    return both.repartition(parts, "part").groupBy("part").applyInArrow(head, "item long, key long")


def similar(sets: list[np.ndarray]) -> np.ndarray:
    """The least member of the component of each set; sets link if their similarity is 4/5 or more."""
    sizes = np.array([len(x) for x in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    owners = owner[order]
    starts, lengths = runs(flat[order])
    number = np.empty(len(flat), dtype=np.int64)
    number[order] = np.repeat(np.arange(len(starts)), lengths)
    own_edges, parent = np.r_[0, np.cumsum(sizes)], np.arange(len(sets))
    for i in range(len(sets)):
        mine = number[own_edges[i] : own_edges[i + 1]]
        n = lengths[mine]
        n, mine = n[n > 1], mine[n > 1]
        if not len(n):
            continue
        at = np.arange(int(n.sum())) + np.repeat(starts[mine] - (np.cumsum(n) - n), n)
        shared = np.bincount(owners[at], minlength=len(sets))
        linked = np.flatnonzero(9 * shared[:i] >= 4 * (sizes[:i] + sizes[i]))
        if len(linked):
            parent = joined(len(sets), np.full(len(linked), i), linked, parent)
    return parent


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have a similarity of 4/5 or more. Of b many rows may be the same."""
    met = pairs.join(sets.select(F.col("key").alias("b"), F.col("items").alias("of_b")), "b").join(sets.select(F.col("key").alias("a"), F.col("items").alias("of_a")), "a")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                if 5 * min(len(x), len(y)) < 4 * max(len(x), len(y)):
                    keep.append(False)
                    continue
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                keep.append(9 * int((y[at] == x).sum()) >= 4 * (len(x) + len(y)))
            yield batch.select([0, 1]).filter(pa.array(keep, type=pa.bool_()))

    return met.select("a", "b", "of_a", "of_b").mapInArrow(compare, "a long, b long")


def blocks_compared(lists: DataFrame, sets: DataFrame, most: int) -> DataFrame:
    """(a, b): links among the texts of each component of lists (item, key), which are cut into blocks."""
    least = lists.groupBy("item").agg(F.min("key").alias("least"))
    near = contract(lists.join(least, "item").where("key <> least").select(F.col("key").alias("a"), F.col("least").alias("b")))
    member = near.unionByName(near.select(F.col("b").alias("a"), "b").distinct())
    blocks = member.groupBy("b").agg(F.ceil(F.count("*") / most).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = member.join(blocks, "b").withColumn("own", own).withColumn("other", other).select("a", "b", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def compare(rows: pa.Table) -> pa.Table:
        keys = rows["key"].to_numpy()
        order = np.argsort(keys, kind="stable")
        blobs = rows["items"].to_pylist()
        parent = similar([np.frombuffer(blobs[i], dtype=np.uint64) for i in order.tolist()])
        moved = np.flatnonzero(parent != np.arange(len(parent)))
        return pa.table({"a": pa.array(keys[order[moved]]), "b": pa.array(keys[order[parent[moved]]])})

    pairs = dealt.join(sets, dealt["a"] == sets["key"]).select(F.col("b").alias("component"), "i", "j", "key", "items")
    return pairs.groupBy("component", "i", "j").applyInArrow(compare, "a long, b long")


def open_lists(lists: DataFrame, links: DataFrame | None) -> DataFrame:
    """(item, key, of, share) of the lists in which several components of the links meet; of: the component."""
    if links is None:
        return lists.withColumn("of", F.col("key"))
    least = contract(links)
    named = lists.join(least, lists["key"] == least["a"], "left").select(*lists.columns, F.coalesce("b", "key").alias("of"))
    apart = named.groupBy("item").agg(F.min("of").alias("x"), F.max("of").alias("y")).where("x < y").select("item")
    return named.join(apart, "item", "left_semi")


def similar_texts(docs: DataFrame, size: int = 5, key: str = "key", text: str = "text", most: int = MOST, range_bytes: int = RANGE_BYTES, stars: int = STARS, short: int = SHORT, most_hot: int = MOST_HOT) -> DataFrame:
    """(a, b): links of keys whose components are those of all pairs of texts with a similarity of 4/5 or more. Rows
    that share a key have one text; key: long, not null. A null text is empty; texts without words are alike."""
    ship(docs.sparkSession)
    parts = count_blocks(docs, range_bytes, text=text)
    plain = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    found = stage(heads(plain, parts, size), "heads")
    equal = found.where("rep is not null").select(F.col("key").alias("a"), F.col("rep").alias("b"))
    left = found.groupBy("key").agg(F.max("need").alias("need"), F.sum("found").alias("found"), F.min("rep").alias("rep")).where("rep is null and found >= need")
    left = stage(left.select("key", (F.col("found") / F.col("need")).alias("share")), "left")

    def sets_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield to_batch({"key": batch.column(0), "items": [shingle_set(x, size).tobytes() for x in batch.column(1).cast(pa.binary()).to_pylist()]}, pa.schema([("key", pa.int64()), ("items", pa.binary())]))

    sets = stage(plain.join(left, "key", "left_semi").mapInArrow(sets_of, "key long, items binary").dropDuplicates(["key"]), "sets")
    lists = stage(rare_items(sets, parts, frequent(sets, parts, most_hot)).join(left, "key").select("item", "key", "share"), "lists")
    links = None
    for _ in range(stars):
        now = stage(open_lists(lists, links), "open")
        centre = now.groupBy("item").agg(F.max_by(F.struct("key", "of"), F.struct("share", -F.col("key"))).alias("centre"))
        met = now.join(centre, "item")
        new = alike(met.where("of <> centre.of").select(F.col("key").alias("a"), F.col("centre.key").alias("b")).distinct(), sets)
        links = stage(new if links is None else links.unionByName(new), "alike")
        lists = stage(met.where("key <> centre.key").select("item", "key", "share"), "lists")  # all pairs with the centre are done
    now = stage(open_lists(lists, links), "open")
    long = now.groupBy("item").count().where(F.col("count") > short).select("item")
    few = now.join(long, "item", "left_anti")
    other = few.select("item", F.col("key").alias("b"), F.col("of").alias("of_b"))
    pairs = few.join(other, "item").where("key < b and of <> of_b").select(F.col("key").alias("a"), "b").distinct()
    rest = alike(pairs, sets).unionByName(blocks_compared(now.join(long, "item", "left_semi").select("item", "key"), sets, most))
    return stage(equal.unionByName(rest if links is None else rest.unionByName(links)), "similar")
