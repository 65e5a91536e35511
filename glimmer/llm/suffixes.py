"""Removal of repeated passages by a depth-limited radix sort of suffixes.

A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller identifier. Suffixes
are ordered by their first `length` bytes only, most significant digit first; a group that is equal to that depth is a
repeated window, and its smallest identifier decides for all its members.

The first digit deals suffixes to tasks. It is the window's anchor, the k-byte string with the least hash in it, and
the place of the anchor in the window: equal windows have equal anchors at equal places. Consecutive windows mostly
share their anchor, so they travel as one stretch of text. Before any text travels, blocks of documents send the hashes
of their anchors; only stretches around anchors that occur in two documents go on. Within a block, equal stretches go
once, with their smallest identifier, so a group of copies adds one row for each block and not for each document. An
anchor that very many blocks hold, among very many different stretches, is dealt by whole windows instead, which spreads
what stands around it. Where they meet, equal stretches become one, and only anchors with several different stretches
are looked at window by window. The digits that follow are eight bytes each and refine only groups that are still mixed.
A bit for each window, whether it starts in a smaller document, returns to the blocks, which cut the text.

Hashes only bring together what may be equal; whatever counts as equal was compared byte by byte.

Equal texts are dealt to one block, but for those that would fill much of it, which go to all. A copy of a smaller
document's text goes as a whole, so a block looks at the first of equal texts only.

Texts shorter than `length` lose nothing; a null text is empty. Matches never cross documents. Rows that repeat an
identifier count as one document. A null identifier ranks last, level with the largest number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.llm.common import pack, quoted, ship, unpack

#: Stands for a null identifier while texts are compared.
LAST = 2**63 - 1
#: Bytes of documents in a block. Rows between blocks and buckets are as many as the square of the blocks.
BLOCK_BYTES = 16 << 20
#: Bytes that are hashed together.
PIECE = 1 << 17
#: An anchor in so many blocks, and in so many stretches that differ within theirs, is dealt by whole windows.
MANY_BLOCKS, MANY_TEXTS = 512, 1 << 15
#: Windows that are sorted together, or a little more.
SORTED = 1 << 20

U = np.uint64
#: Multipliers and byte values of the hash, from a fixed linear congruence.
MULTIPLY, MIX, MIX2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * MIX
    x = (x ^ (x >> U(27))) * MIX2
    return x ^ (x >> U(31))


BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * MULTIPLY)


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse."""
    found = np.full((2, n), MULTIPLY)
    found[1] = pow(int(MULTIPLY), -1, 1 << 64)
    found[:, 0] = 1
    up, down = np.cumprod(found, axis=1)
    return up, down


def window_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each width consecutive values."""
    have, size = values, 1
    while size * 2 <= width:
        have = np.minimum(have[: len(have) - size], have[size:])
        size *= 2
    rest = width - size
    return np.minimum(have[: len(have) - rest], have[rest:]) if rest else have


def eights(buffer: bytes) -> np.ndarray:
    """The eight bytes from each position on, as numbers; the last seven run into zeros."""
    return np.ndarray((len(buffer) + 1,), dtype=np.uint64, buffer=buffer + bytes(16), strides=(1,))


def spread_out(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... of each i, count[i] numbers."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - ends + count, count)


def equal_texts(words: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the size[i] >= 8 bytes from a[i] and from b[i] on are equal."""
    same = np.ones(len(a), dtype=bool)
    for shift in range(0, int(size.max(initial=0)), 8):
        at = np.minimum(shift, size - 8)
        same &= words[a + at] == words[b + at]
    return same


def equal_to(words: np.ndarray, start: np.ndarray, size: np.ndarray, place: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Of each text (size[i] bytes from start[i] on, its anchor at place[i]) the number of one that is equal in all: of
    those with the same value, a hash of the text, the first, or its own number if its bytes are not those of the first."""
    order = np.argsort(value, kind="stable")
    begins = np.r_[True, value[order][1:] != value[order][:-1]] if len(order) else np.zeros(0, dtype=bool)
    first = order[np.maximum.accumulate(np.where(begins, np.arange(len(order)), 0))]
    other = order != first
    a, b = order[other], first[other]
    same = (size[a] == size[b]) & (place[a] == place[b])
    a, b = a[same], b[same]
    same = equal_texts(words, start[a], start[b], size[a])
    out = np.arange(len(start))
    out[a[same]] = b[same]
    return out


def text_hashes(words: np.ndarray, start: np.ndarray, size: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Of each text (as in equal_to) a hash of all of it."""
    out = mixed((size << 32 | place).astype(np.uint64) * MULTIPLY)
    for shift in range(0, int(size.max(initial=0)), 8):
        out = (out ^ (out >> U(29))) * MIX + words[start + np.minimum(shift, size - 8)] * MULTIPLY
    return mixed(out)


class Stretches:
    """The texts of a block as one buffer, without copies of a smaller document's; and its stretches of windows with a
    common anchor: lo and hi (first and last window), at (the anchor), hash (of the anchor), whole (a hash of the
    stretch) and doc (its identifier)."""

    def __init__(self, ids: list[int], texts: list[bytes], length: int, k: int) -> None:
        rows = sorted(zip(ids, texts, range(len(ids)), strict=True))
        self.length, self.rows = length, [row for _, _, row in rows]
        self.ids = np.array([doc for doc, _, _ in rows], dtype=np.int64)
        self.sizes, first = np.array([len(text) for _, text, _ in rows], dtype=np.int64), {}
        self.copies = np.array([first.setdefault(text, doc) < doc for doc, text, _ in rows], dtype=bool) & (self.sizes >= length)
        self.buffer = b"".join([text for (_, text, _), copy in zip(rows, self.copies.tolist(), strict=True) if not copy])
        self.ends = np.cumsum(np.where(self.copies, 0, self.sizes))
        self.starts = np.r_[0, self.ends][:-1]
        data = np.frombuffer(self.buffer, dtype=np.uint8)
        found = [self.piece(data, a, b, length, k) for a, b in self.pieces(length)]
        self.lo, self.hi, self.at, self.hash, self.whole = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, dtype=np.uint64 if i > 2 else np.int64) for i in range(5))
        self.doc = self.ids[np.searchsorted(self.ends, self.lo, side="right")] if len(self.lo) else np.zeros(0, dtype=np.int64)

    def pieces(self, length: int) -> Iterator[tuple[int, int]]:
        """Ranges of first bytes of windows, of at most PIECE."""
        total = len(self.buffer) - length + 1
        for a in range(0, max(0, total), PIECE):
            yield a, min(a + PIECE, total)

    def piece(self, data: np.ndarray, a: int, b: int, length: int, k: int) -> tuple[np.ndarray, ...]:
        part = data[a : b + length - 1]
        up, down = powers(PIECE + length)
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(BYTE[part] * up[: len(part)], out=sums[1:])
        hashes = (sums[k:] - sums[:-k]) * down[: len(part) - k + 1]  # of the k bytes from each position on
        order = (hashes & U(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
        anchor = (window_least(order, length - k + 1) & U(0xFFFFFFFF)).astype(np.int64)
        edges = np.r_[True, anchor[1:] != anchor[:-1]]
        inside = np.ones(b - a, dtype=bool)  # windows that do not cross the end of a text
        first = np.searchsorted(self.ends, a, side="right")
        for end in self.ends[first : np.searchsorted(self.ends, b + length, side="left") + 1].tolist():
            inside[max(0, end - length + 1 - a) : max(0, end - a)] = False
            if 0 <= end - a < len(edges):
                edges[end - a] = True
        begin = np.flatnonzero(edges & inside)
        if not begin.size:
            return begin, begin, begin, np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
        stop = np.flatnonzero(inside & np.r_[edges[1:] | ~inside[1:], True])
        own = anchor[begin]
        whole = (sums[stop + length] - sums[begin]) * down[begin] + (own - begin).astype(np.uint64) * MIX + (stop - begin).astype(np.uint64) * MIX2
        return begin + a, stop + a, own + a, mixed(hashes[own]), mixed(whole)

    def keys(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct anchors as ascending numbers, some 32 bits and those of a bucket, and of each stretch its place
        among them."""
        key = self.hash >> U(64 - key_bits(buckets))
        order = np.argsort(key, kind="stable")
        begins = np.r_[True, key[order][1:] != key[order][:-1]] if len(key) else np.zeros(0, dtype=bool)
        place = np.empty(len(key), dtype=np.int64)
        place[order] = np.cumsum(begins) - 1
        return key[order[begins]], place

    def twins(self, place: np.ndarray, several: np.ndarray) -> np.ndarray:
        """Of each stretch the first one that is equal to it, or itself; several: of each anchor whether it has several
        stretches."""
        out = np.arange(len(self.lo))
        rows = np.flatnonzero(several[place])
        if len(rows):
            lo = self.lo[rows]
            out[rows] = rows[equal_to(eights(self.buffer), lo, self.hi[rows] - lo + self.length, self.at[rows] - lo, self.whole[rows])]
        return out

    def contents(self, states: np.ndarray, place: np.ndarray, keys: np.ndarray, buckets: int) -> tuple[dict, dict]:
        """What to send, by bucket: the different texts (bucket, start, n windows, place of the anchor, smallest doc);
        and the uses of them, by start: (number of the text, start, n windows, doc)."""
        length, state = self.length, states[place]
        twin = self.twins(place, (np.bincount(place, minlength=len(keys)) > 1) & (states == 1))
        own = np.flatnonzero(state == 1)
        found = [(bucket_of(keys, buckets)[place[own]], self.lo[own], self.hi[own] - self.lo[own] + 1, self.at[own] - self.lo[own], self.doc[own], twin[own])]
        many = np.flatnonzero(state == 2)
        if len(many):
            windows = self.hi[many] - self.lo[many] + 1
            start = spread_out(self.lo[many], windows)
            at = np.repeat(self.at[many], windows) - start
            words, size = eights(self.buffer), np.full(len(start), length)
            value = text_hashes(words, start, size, at)
            found.append((bucket_of(value >> U(64 - key_bits(buckets)), buckets), start, np.ones(len(start), dtype=np.int64), at, np.repeat(self.doc[many], windows), len(self.lo) + equal_to(words, start, size, at, value)))
        bucket, start, windows, at, doc, twin = (np.concatenate([x[i] for x in found]) for i in range(6))
        _, first, number = np.unique(twin, return_index=True, return_inverse=True)
        least = np.full(len(first), LAST)
        np.minimum.at(least, number, doc)
        order = np.argsort(bucket[first], kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        first, by = first[order], np.argsort(start, kind="stable")
        sent = {"bucket": bucket[first], "start": start[first], "windows": windows[first], "at": at[first], "doc": least[order]}
        return sent, {"text": rank[number][by], "start": start[by], "windows": windows[by], "doc": doc[by]}


def key_bits(buckets: int) -> int:
    return 32 + buckets.bit_length()


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The buckets are ranges of keys."""
    return ((keys >> U(key_bits(buckets) - 32)) * U(buckets) >> U(32)).astype(np.int64)


def ranges(buckets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of each run of ascending buckets."""
    if len(buckets):
        edge = np.flatnonzero(buckets[1:] != buckets[:-1]) + 1
        begin = np.r_[0, edge]
        yield from zip(buckets[begin].tolist(), begin.tolist(), np.r_[edge, len(buckets)].tolist(), strict=True)


def pack_planes(array: np.ndarray) -> bytes:
    """Numbers of eight bytes, all their first bytes first."""
    return pack(array.view(np.uint8).reshape(-1, 8).T)


def unpack_planes(blob: bytes, size: int, dtype) -> np.ndarray:
    return np.ascontiguousarray(unpack(blob, 8 * size, np.uint8).reshape(8, size).T).reshape(-1).view(dtype)


def read_block(table: pa.Table, length: int, k: int) -> Stretches:
    return Stretches(table.column("doc").to_pylist(), table.column("text").cast(pa.binary()).to_pylist(), length, k)


def repeated_windows(doc: np.ndarray, at: np.ndarray, first: np.ndarray, words: np.ndarray, length: int) -> np.ndarray:
    """Of each window the smallest identifier among equal ones. at: its place in the buffer; first: its first digit;
    words: the eight bytes from each place of the buffer on."""
    least = doc.copy()
    order = np.argsort(first, kind="stable")
    begins = np.r_[True, first[order][1:] != first[order][:-1]] if len(order) else np.zeros(0, dtype=bool)

    def apart(order: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Without groups that lie in one document."""
        if not len(order):
            return order, begins
        starts = np.flatnonzero(begins)
        own = doc[order]
        keep = np.repeat(np.minimum.reduceat(own, starts) != np.maximum.reduceat(own, starts), np.diff(np.r_[starts, len(order)]))
        return order[keep], begins[keep]

    order, begins = apart(order, begins)
    for shift in [*range(0, length - 8, 8), length - 8]:
        if not len(order):
            break
        digit = words[at[order] + shift]
        differs = np.r_[False, (digit[1:] != digit[:-1]) & ~begins[1:]]
        if differs.any():
            group = np.cumsum(begins) - 1
            mixed_groups = np.zeros(group[-1] + 1, dtype=bool)
            mixed_groups[group[differs]] = True
            rows = np.flatnonzero(mixed_groups[group])
            by = np.lexsort((digit[rows], group[rows]))
            order[rows], digit[rows] = order[rows][by], digit[rows][by]
            begins = begins | np.r_[False, digit[1:] != digit[:-1]]
        order, begins = apart(order, begins)
    if len(order):
        starts = np.flatnonzero(begins)
        least[order] = np.repeat(np.minimum.reduceat(doc[order], starts), np.diff(np.r_[starts, len(order)]))
    return least


def starts_before(words: np.ndarray, start: np.ndarray, windows: np.ndarray, place: np.ndarray, docs: np.ndarray, length: int, k: int) -> np.ndarray:
    """Of each window of these texts, in their order, whether it also starts in a text with a smaller identifier."""
    size = windows + length - 1
    twin = equal_to(words, start, size, place, text_hashes(words, start, size, place))
    own, number = np.unique(twin, return_inverse=True)
    doc = np.full(len(own), LAST)
    np.minimum.at(doc, number, docs)
    anchor = start[own] + place[own]
    digit = mixed(words[anchor] * MULTIPLY + words[anchor + k - 8])
    order = np.argsort(digit, kind="stable")
    begins = np.flatnonzero(np.r_[True, digit[order][1:] != digit[order][:-1]])
    times = np.diff(np.r_[begins, len(order)])
    order = order[np.repeat(times > 1, times)]  # anchors with several different stretches
    count = windows[own]
    ends = np.cumsum(count)
    least = np.repeat(doc, count)
    done = np.cumsum(times[times > 1])
    total = np.cumsum(count[order])[done - 1] if len(done) else done  # windows up to the end of each anchor
    edges = done[np.searchsorted(total, np.arange(SORTED, total[-1], SORTED))] if len(done) else done
    for rows in np.split(order, np.unique(edges)):
        inner = spread_out(np.zeros(len(rows), dtype=np.int64), count[rows])
        first = mixed(np.repeat(digit[rows], count[rows]) + (np.repeat(place[own[rows]], count[rows]) - inner).astype(np.uint64))
        at = np.repeat(start[own[rows]], count[rows]) + inner
        least[np.repeat(ends[rows] - count[rows], count[rows]) + inner] = repeated_windows(np.repeat(doc[rows], count[rows]), at, first, words, length)
    out = np.empty(int(windows.sum()), dtype=bool)
    stop = np.cumsum(windows)
    before = 0
    while before < len(windows):  # some at a time
        to = max(before + 1, int(np.searchsorted(stop, (stop[before - 1] if before else 0) + SORTED, side="right")))
        part = slice(before, to)
        out[stop[before] - windows[before] : stop[to - 1]] = least[spread_out((ends - count)[number[part]], windows[part])] < np.repeat(docs[part], windows[part])
        before = to
    return out


ASKED = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("n", pa.int64()), ("keys", pa.binary()), ("texts", pa.binary())])
SENT = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("n", pa.int64()), ("texts", pa.binary()), ("n_bytes", pa.int64()), ("windows", pa.binary()), ("places", pa.binary()), ("docs", pa.binary())])
REPLY = pa.schema([("kind", pa.int32()), ("block", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64()), ("data", pa.binary())])
REPLY_DDL = "kind int, block int, bucket int, n long, data binary"
CUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("starts", pa.list_(pa.int64())), ("stops", pa.list_(pa.int64())), ("kept", pa.binary())])


def as_table(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=schema)


def reply(kind: int, block: int, bucket: int, flags: np.ndarray) -> dict:
    """flags: a byte for each anchor (kind 0), a bit for each window (kind 1)."""
    return {"kind": kind, "block": block, "bucket": bucket, "n": len(flags), "data": pack(np.packbits(flags) if kind else flags)}


def replied(replies: list[dict], kind: int) -> np.ndarray:
    found = sorted((r["bucket"], r["n"], r["data"]) for r in replies if r["kind"] == kind)
    if kind:
        return np.concatenate([np.zeros(0, dtype=bool), *(np.unpackbits(unpack(data, (n + 7) // 8, np.uint8), count=n).view(bool) for _, n, data in found)])
    return np.concatenate([np.zeros(0, dtype=np.uint8), *(unpack(data, n, np.uint8) for _, n, data in found)])


def going_windows(sent: dict, uses: dict, before: np.ndarray) -> np.ndarray:
    """The windows of a block, ascending, that also start in a smaller document. before: whether those of the texts sent do."""
    begin, out = np.cumsum(sent["windows"]) - sent["windows"], [np.zeros(0, dtype=np.int64)]
    for a in range(0, len(uses["text"]), 1 << 15):
        text, start, windows, doc = (uses[x][a : a + (1 << 15)] for x in ("text", "start", "windows", "doc"))
        goes = before[spread_out(begin[text], windows)] | np.repeat(sent["doc"][text] < doc, windows)
        out.append(spread_out(start, windows)[goes])
    return np.concatenate(out)


def byte_counts(plain: DataFrame, most: int) -> tuple[int, list[int]]:
    """The bytes of all texts, and the hashes of texts that have more than so many bytes with their copies."""
    held = plain.groupBy(F.xxhash64("text").alias("hash")).agg(F.sum(F.octet_length("text")).alias("size"))
    n_bytes, large = held.agg(F.sum("size"), F.collect_list(F.when(F.col("size") > most, F.col("hash")))).first()
    return int(n_bytes or 0), large


def cut_repeats(docs: DataFrame, length: int = 50, k: int = 20, block_bytes: int = BLOCK_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, starts, stops, kept) of each row: the maximal removed runs as byte offsets, and the
    bytes that stay."""
    if not 8 <= k < length:
        raise ValueError("8 <= k < length")
    ship(docs.sparkSession)
    name, content = F.col(quoted(key)).cast("long"), F.coalesce(F.col(quoted(text)).cast("string"), F.lit(""))
    plain = docs.select(F.coalesce(name, F.lit(LAST)).alias("doc"), name.isNull().alias("none"), content.alias("text"))
    n_bytes, large = byte_counts(plain, block_bytes // 4)
    n_blocks = n_buckets = max(16, math.ceil(n_bytes / block_bytes))
    spread = F.when(F.xxhash64("text").isin(large), F.xxhash64("doc", "text")).otherwise(F.xxhash64("text")) if large else F.xxhash64("text")
    spread = F.pmod(spread, F.lit(n_blocks)).cast("int")
    blocks = plain.withColumn("block", spread).repartition(n_blocks, "block")

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        own, rows, block = read_block(table, length, k), [], key[0].as_py()
        keys, place = own.keys(n_buckets)
        if len(keys):
            low, high = np.full(len(keys), LAST), np.full(len(keys), -LAST - 1)
            np.minimum.at(low, place, own.doc)
            np.maximum.at(high, place, own.doc)
            twin = own.twins(place, np.bincount(place) > 1)
            texts = np.minimum(np.bincount(place[twin == np.arange(len(twin))], minlength=len(keys)), 127).astype(np.uint8) | (low != high).astype(np.uint8) << np.uint8(7)
            for bucket, a, b in ranges(bucket_of(keys, n_buckets)):
                rows.append({"bucket": bucket, "block": block, "n": b - a, "keys": pack_planes(np.diff(keys[a:b], prepend=U(0))), "texts": pack(texts[a:b])})
        return as_table(rows, ASKED)

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        _, place, count = np.unique(np.concatenate([np.cumsum(unpack_planes(r["keys"], r["n"], np.uint64)) for r in rows]), return_inverse=True, return_counts=True)
        texts = np.concatenate([unpack(r["texts"], r["n"], np.uint8) for r in rows])
        again = count > 1
        again[place[texts > 127]] = True
        many = (count >= MANY_BLOCKS) & (np.bincount(place, weights=texts & np.uint8(127)) >= MANY_TEXTS)
        state = (again.astype(np.uint8) + (again & many).astype(np.uint8))[place]
        ends = np.cumsum([r["n"] for r in rows]).tolist()
        return as_table([reply(0, r["block"], r["bucket"], state[end - r["n"] : end]) for r, end in zip(rows, ends, strict=True)], REPLY)

    def send(key: tuple, replies: pa.Table, table: pa.Table) -> pa.Table:
        if not table.num_rows or not replies.num_rows:
            return as_table([], SENT)
        own, rows, block = read_block(table, length, k), [], key[0].as_py()
        keys, place = own.keys(n_buckets)
        sent, _ = own.contents(replied(replies.to_pylist(), 0), place, keys, n_buckets)
        for bucket, a, b in ranges(sent["bucket"]):
            start, windows = sent["start"][a:b], sent["windows"][a:b]
            joined = b"".join([own.buffer[x:y] for x, y in zip(start.tolist(), (start + windows + length - 1).tolist(), strict=True)])
            rows.append({
                "bucket": bucket, "block": block, "n": b - a, "texts": pack(np.frombuffer(joined, dtype=np.uint8)), "n_bytes": len(joined),
                "windows": pack(windows.astype(np.uint32)), "places": pack(sent["at"][a:b].astype(np.uint32)), "docs": pack_planes(sent["doc"][a:b]),
            })
        return as_table(rows, SENT)

    def sort(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        words = eights(b"".join([unpack(r["texts"], r["n_bytes"], np.uint8).tobytes() for r in rows]))
        windows, places = (np.concatenate([unpack(r[x], r["n"], np.uint32) for r in rows]).astype(np.int64) for x in ("windows", "places"))
        docs = np.concatenate([unpack_planes(r["docs"], r["n"], np.int64) for r in rows])
        sizes = windows + length - 1
        goes = starts_before(words, np.cumsum(sizes) - sizes, windows, places, docs, length, k)
        totals = np.add.reduceat(windows, np.cumsum([0, *[r["n"] for r in rows[:-1]]]))
        return as_table([reply(1, r["block"], r["bucket"], goes[end - n : end]) for r, n, end in zip(rows, totals.tolist(), np.cumsum(totals).tolist(), strict=True)], REPLY)

    def cut(key: tuple, replies: pa.Table, table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return CUT.empty_table()
        own, found = read_block(table, length, k), replies.to_pylist()
        gone = np.zeros(0, dtype=np.int64)
        if found:
            keys, place = own.keys(n_buckets)
            gone = going_windows(*own.contents(replied(found, 0), place, keys, n_buckets), replied(found, 1))
        of = np.searchsorted(own.ends, gone, side="right")
        edge = np.flatnonzero((np.diff(gone) > length) | (np.diff(of) > 0)) + 1
        begin = np.r_[np.zeros(min(1, len(gone)), dtype=np.int64), edge]
        copies = np.flatnonzero(own.copies)
        run = np.r_[of[begin], copies]
        order = np.argsort(run, kind="stable")
        start = np.r_[gone[begin] - own.starts[of[begin]], np.zeros(len(copies), dtype=np.int64)][order]
        stop = np.r_[gone[np.r_[edge, len(gone)][: len(begin)] - 1] + length - own.starts[of[begin]], own.sizes[copies]][order]
        at = np.searchsorted(run[order], np.arange(len(own.ids) + 1))  # the runs of each text
        removed = np.diff(np.r_[0, np.cumsum(stop - start)][at])
        kept, starts, stops = [], start.tolist(), stop.tolist()
        for a, b, i, j in zip(own.starts.tolist(), own.ends.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
            kept.append(b"".join([own.buffer[a + x : a + y] for x, y in zip([0, *stops[i:j]], [*starts[i:j], b - a], strict=True)]) if j > i else own.buffer[a:b])
        none = table.column("none").to_pylist()
        doc = [None if none[row] else doc for row, doc in zip(own.rows, own.ids.tolist(), strict=True)]
        lists = [pa.ListArray.from_arrays(pa.array(at, type=pa.int32()), pa.array(x)) for x in (start, stop)]
        return pa.table([pa.array(doc, type=pa.int64()), pa.array(own.sizes), pa.array(removed), *lists, pa.array(kept, type=pa.binary())], schema=CUT)

    asked = blocks.groupBy("block").applyInArrow(ask, "bucket int, block int, n long, keys binary, texts binary")
    repeated = asked.repartition(n_buckets, "bucket").groupBy("bucket").applyInArrow(compare, REPLY_DDL)
    sent = repeated.repartition(n_blocks, "block").groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(send, "bucket int, block int, n long, texts binary, n_bytes long, windows binary, places binary, docs binary")
    least = sent.repartition(n_buckets, "bucket").groupBy("bucket").applyInArrow(sort, REPLY_DDL)
    answers = repeated.unionByName(least).repartition(n_blocks, "block")
    return answers.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(cut, "doc_id long, n_bytes long, n_removed long, starts array<long>, stops array<long>, kept binary")
