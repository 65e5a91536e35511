"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised byte by byte: A to Z become lower case, other ASCII that is no letter or digit separates words, and
all bytes beyond ASCII belong to words. As each byte stays in its place, a word's offsets are those in the original.
The windows of all test texts form one automaton over numbered words, so a window of ten words is ten nodes at most; each
document is scanned once.

The automaton is flat arrays (goto by hash, fail, output), built level by level and written to the shared folder. Workers
map the files, so those of one machine share one copy; where the folder is no mounted file system each reads its own. All
texts of a batch are one sequence of word numbers, cut into pieces that step through the automaton together. A piece
begins window - 1 words early: a node says nothing of words further back.

An automaton holds at most MOST_NODES nodes, some 32 to 56 bytes each. Test texts that need more, or parts of one that does,
are dealt to several; one after another is read, built, scanned with and removed, and the hits are put together by row, so
results are the same.

A test text of fewer words than a window is one window; one without words has none. Null documents have no words; a null
test text has none either. A test text without identifier counts as an item, a null in the list of items.
"""

from __future__ import annotations

import io
import itertools
import re
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.llm.common import documents, keep_rows, quoted, scratch_path, ship, slices, stage
from glimmer.llm.warc import store_of

#: Nodes of an automaton at most.
MOST_NODES = 16_000_000
#: Words of a piece.
PIECE = 64

#: Of each byte, what it is in normalised text: a separator becomes a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
WORD = re.compile(rb"[^ ]+")
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
HITS = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", SPANS), ("items", pa.list_(pa.string()))])
HITS_DDL = "n_words long, n_hit long, spans array<struct<start: long, stop: long>>, items array<string>"
#: A test text, or a part of one: its name and words.
Item = tuple[str | None, list[bytes]]


def sorted_items(names: Iterable[str | None]) -> list[str | None]:
    """In the order of strings, a null last."""
    return sorted(names, key=lambda x: (x is None, x or ""))


def mixed(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def hashed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys by open addressing: (slot -> key or -1, slot -> place of the key)."""
    bits = max(4, int(2 * len(keys)).bit_length())
    slots, places = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int32)
    open_, at = np.arange(len(keys)), mixed(keys, bits)
    while len(open_):
        free = slots[at] < 0
        slots[at[free]] = keys[open_[free]]
        won = slots[at] == keys[open_]
        places[at[won]] = open_[won]
        open_, at = open_[~won], (at[~won] + 1) & ((1 << bits) - 1)
    return slots, places


def built(items: list[Item], size: int) -> dict[str, np.ndarray]:
    """The arrays of the automaton of all windows of the items."""
    number: dict[bytes, int] = {}
    flat, starts, lengths, owner, base = [], [], [], [], 0
    for i, (_, words) in enumerate(items):
        flat.append(np.fromiter((number.setdefault(w, len(number) + 1) for w in words), dtype=np.int64, count=len(words)))
        n = max(1, len(words) - size + 1) if words else 0
        starts.append(base + np.arange(n))
        lengths.append(np.full(n, min(size, len(words))))
        owner.append(np.full(n, i))
        base += len(words)
    words, starts, lengths, owner = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (flat, starts, lengths, owner))
    v = len(number) + 1
    node, edges, above = np.zeros(len(starts), dtype=np.int64), [], [0]
    for level in range(size):  # a level's nodes are the distinct (parent, word)
        own = np.flatnonzero(lengths > level)
        found, back = np.unique(node[own] * v + words[starts[own] + level], return_inverse=True)
        node[own] = sum(above) + 1 + back
        edges.append(found)
        above.append(len(found))
    keys = np.concatenate(edges) if edges else np.zeros(0, dtype=np.int64)
    slots, places = hashed(keys)
    depths = np.repeat(np.arange(size + 1), [1, *(len(x) for x in edges)]).astype(np.int32)
    ends, groups = np.unique(np.stack([node, owner]), axis=1) if len(node) else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
    own_end = np.zeros(len(depths), dtype=bool)
    own_end[ends] = True
    fail, chain, following = (np.zeros(len(depths), dtype=np.int32) for _ in range(3))
    machine = {"slots": slots, "places": places, "fail": fail, "words": np.array([v])}
    at = 1
    for level, found in enumerate(edges):
        ids = at + np.arange(len(found))
        if level:
            fail[ids] = stepped(machine, fail[found // v].astype(np.int64), found % v)
        following[ids] = chain[fail[ids]]
        chain[ids] = np.where(own_end[ids], ids, following[ids])
        at += len(found)
    names = [x for x, _ in items]
    return machine | {
        "depth": depths, "chain": chain, "following": following, "ends": ends, "owners": groups,
        "vocabulary": np.frombuffer(b" ".join(number) or b" ", dtype=np.uint8), "names": np.frombuffer("\0".join("-" if x is None else f"={x}" for x in names).encode() or b" ", dtype=np.uint8),
    }


def stepped(machine: dict[str, np.ndarray], state: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The states after each state's next word; a word of no window is 0."""
    slots, places, fail, v = machine["slots"], machine["places"], machine["fail"], int(machine["words"][0])
    mask, bits = len(slots) - 1, len(slots).bit_length() - 1
    out = np.zeros(len(state), dtype=np.int64)
    open_ = np.flatnonzero(word > 0)
    now, word = state[open_], word[open_]
    while len(open_):
        key = now * v + word
        at = mixed(key, bits)
        there = slots[at]
        wrong = np.flatnonzero((there != key) & (there >= 0))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & mask
            there[wrong] = slots[at[wrong]]
            wrong = wrong[(there[wrong] != key[wrong]) & (there[wrong] >= 0)]
        hit = there == key
        out[open_[hit]] = places[at[hit]] + 1
        rest = ~hit & (now > 0)  # at the root a word that leads nowhere stays there
        open_, now, word = open_[rest], fail[now[rest]].astype(np.int64), word[rest]
    return out


class Automaton:
    """The windows of some items, over the numbers of their words; zero stands for all other words."""

    def __init__(self, machine: dict[str, np.ndarray], size: int) -> None:
        self.machine, self.size = machine, size
        self.number = {w: i for i, w in enumerate(machine["vocabulary"].tobytes().split(), 1)}
        self.names = [None if x == "-" else x[1:] for x in machine["names"].tobytes().decode().split("\0")]

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all words, each text's followed by a zero; and where texts begin."""
        parts, sizes, get = [], [], self.number.get
        for text in texts:
            own = text.translate(FOLD).split()
            parts.append(np.fromiter(map(get, own, repeat(0)), dtype=np.int64, count=len(own)))
            parts.append(np.zeros(1, dtype=np.int64))
            sizes.append(len(own) + 1)
        return np.concatenate(parts), np.cumsum([0, *sizes])

    def hits(self, sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, node) of all windows that end in the sequence, in order of places."""
        early = self.size - 1
        pieces = -(-len(sequence) // PIECE)
        padded = np.concatenate([np.zeros(early, dtype=np.int64), sequence, np.zeros(pieces * PIECE - len(sequence), dtype=np.int64)])
        lanes = np.arange(pieces) * PIECE
        state, chain = np.zeros(pieces, dtype=np.int64), self.machine["chain"]
        places, nodes = [], []
        for step in range(early + PIECE):
            word = padded[lanes + step]
            state = stepped(self.machine, state, word) if word.any() else np.zeros(pieces, dtype=np.int64)
            if step >= early:
                found = np.flatnonzero(chain[state] > 0)
                if len(found):
                    places.append(lanes[found] + step - early)
                    nodes.append(state[found])
        if not places:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        place, node, out = np.concatenate(places), chain[np.concatenate(nodes)].astype(np.int64), []
        while len(place):
            out.append((place, node))
            more = self.machine["following"][node]
            place, node = place[more > 0], more[more > 0].astype(np.int64)
        place, node = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((node, place))
        return place[order], node[order]

    def scan(self, texts: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int]], set[str | None]]]:
        """Of each text: its number of words, the runs of hit words as (first, past the last), and the items found."""
        sequence, starts = self.words(texts)
        place, node = self.hits(sequence)
        edges = np.searchsorted(place, starts)
        ends, owners = self.machine["ends"], self.machine["owners"]
        for i in range(len(texts)):
            a, b, start = int(edges[i]), int(edges[i + 1]), int(starts[i])
            if a == b:
                yield int(starts[i + 1]) - start - 1, [], set()
                continue
            stops = place[a:b] - start + 1
            runs = joined_runs(list(zip((stops - self.machine["depth"][node[a:b]]).tolist(), stops.tolist(), strict=True)))
            low, high = np.searchsorted(ends, np.unique(node[a:b])), np.searchsorted(ends, np.unique(node[a:b]), side="right")
            items = {self.names[j] for x, y in zip(low.tolist(), high.tolist(), strict=True) for j in owners[x:y].tolist()}
            yield int(starts[i + 1]) - start - 1, runs, items


def write_machine(spark: SparkSession, items: list[Item], size: int) -> str:
    """The automaton of the items, as files in a folder of the shared one."""
    folder = scratch_path(spark, "automaton")
    store, top = store_of(folder)
    store.create_dir(top)
    for name, array in built(items, size).items():
        with store.open_output_stream(f"{top}/{name}.npy") as out:
            np.lib.format.write_array(out, np.ascontiguousarray(array), allow_pickle=False)
    return folder


def remove_machine(folder: str) -> None:
    store, top = store_of(folder)
    store.delete_dir(top)


_MACHINES: dict[str, Automaton] = {}


def automaton(folder: str, size: int) -> Automaton:
    """The worker's automaton of this folder, mapped where it is a mounted one; it outlives a task."""
    if folder not in _MACHINES:
        from pyarrow import fs

        _MACHINES.clear()
        store, top = store_of(folder)
        arrays = {}
        for info in store.get_file_info(fs.FileSelector(top)):
            name = info.base_name.removesuffix(".npy")
            if isinstance(store, fs.LocalFileSystem):
                arrays[name] = np.load(info.path, mmap_mode="r", allow_pickle=False)
            else:
                with store.open_input_stream(info.path) as file:
                    arrays[name] = np.load(io.BytesIO(file.read()), allow_pickle=False)
        _MACHINES[folder] = Automaton(arrays, size)
    return _MACHINES[folder]


def joined_runs(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted runs, those that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def offsets(text: bytes, runs: list[tuple[int, int]]) -> list[dict[str, int]]:
    """The runs of words as byte offsets in the original text."""
    if not runs:
        return []
    at = [match.span() for match in WORD.finditer(text.translate(FOLD))]
    return [{"start": at[a][0], "stop": at[b - 1][1]} for a, b in runs]


def item_parts(benchmark: DataFrame, size: int, most_nodes: int, key: str, text: str) -> Iterator[list[Item]]:
    """The test texts, in parts whose automata have at most so many nodes; one part at a time is on the driver. A text
    that alone needs more is cut, with an overlap of size - 1 words."""
    rows = benchmark.select(F.col(quoted(key)).cast("string"), F.encode(F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")), "UTF-8"))
    most = max(1, most_nodes // size)
    part, held = [], 0
    for name, content in rows.toLocalIterator():
        words = bytes(content).translate(FOLD).split()
        for start in range(0, max(1, len(words) - size + 1), most):
            own = words[start : start + most + size - 1]
            if part and held + len(own) > most:
                yield part
                part, held = [], 0
            part.append((name, own))
            held += len(own)
    yield part


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", most_nodes: int = MOST_NODES) -> DataFrame:
    """(doc_id, n_words, n_hit, spans, items) of each row: hit words, their runs as byte offsets in the original UTF-8,
    and the sorted identifiers of the items with a window in the text."""
    spark = docs.sparkSession
    ship(spark)
    plain = documents(docs, key, text)
    parts = item_parts(benchmark, window, most_nodes, item_key, item_text)
    part, following = next(parts), next(parts, None)
    if following is None:
        return scanned(plain, "doc_id", write_machine(spark, part, window), window)
    rows = stage(plain.withColumn("row", F.monotonically_increasing_id()), "rows")
    found, parts = [], itertools.chain((part, following), parts)
    del part, following
    for x in parts:
        folder = write_machine(spark, x, window)
        found.append(stage(merged_hits(rows, folder, window), "hits"))
        remove_machine(folder)
    hits = reduce(DataFrame.unionByName, found).groupBy("row").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_list("items")).alias("items"))
    schema = pa.schema([("doc_id", pa.int64()), *HITS])

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: dict[str, list] = {f.name: [] for f in HITS}
            for raw, runs, items in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                runs = joined_runs([(r["start"], r["stop"]) for r in runs or []])
                put(out, raw, len(raw.translate(FOLD).split()), runs, set(items or []))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[f.name], type=f.type) for f in HITS)], schema=schema)

    return rows.join(hits, "row", "left").select("doc_id", "text", "runs", "items").mapInArrow(finish, f"doc_id long, {HITS_DDL}")


def put(out: dict[str, list], raw: bytes, n: int, runs: list[tuple[int, int]], items: set[str | None]) -> None:
    out["n_words"].append(n)
    out["n_hit"].append(sum(b - a for a, b in runs))
    out["spans"].append(offsets(raw, runs))
    out["items"].append(sorted_items(items))


def scanned(plain: DataFrame, key: str, folder: str, window: int) -> DataFrame:
    """(key, the columns of HITS) from (key, text) by one automaton."""
    schema = pa.schema([(key, pa.int64()), *HITS])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from glimmer.llm.decontaminate import automaton as of

        machine = of(folder, window)
        for batch in slices(batches):
            out: dict[str, list] = {f.name: [] for f in HITS}
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for raw, found in zip(texts, machine.scan(texts), strict=True):
                put(out, raw, *found)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[f.name], type=f.type) for f in HITS)], schema=schema)

    return plain.select(key, "text").mapInArrow(run, f"{key} long, {HITS_DDL}")


def merged_hits(rows: DataFrame, folder: str, window: int) -> DataFrame:
    """(row, runs of words, items) of the rows that hold a window of the automaton."""
    schema = pa.schema([("row", pa.int64()), ("runs", SPANS), ("items", pa.list_(pa.string()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from glimmer.llm.decontaminate import automaton as of

        machine = of(folder, window)
        for batch in slices(batches):
            ids, runs, items = [], [], []
            for row, (_, own, names) in zip(batch.column(0).to_pylist(), machine.scan(batch.column(1).cast(pa.binary()).to_pylist()), strict=True):
                if own:
                    ids.append(row)
                    runs.append([{"start": a, "stop": b} for a, b in own])
                    items.append(sorted_items(names))
            yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip((ids, runs, items), schema, strict=True)], schema=schema)

    return rows.select("row", "text").mapInArrow(run, "row long, runs array<struct<start: long, stop: long>>, items array<string>")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item_key: str = "item_id", item_text: str = "text", most_nodes: int = MOST_NODES) -> DataFrame:
    """The rows of docs without any window of a test text, all columns. Each part of the test texts filters once more."""
    spark, last = docs.sparkSession, None
    ship(spark)
    for part in item_parts(benchmark, window, most_nodes, item_key, item_text):
        if last is not None:
            docs = stage(docs, "clean")  # so that a worker maps one automaton at a time
            remove_machine(last)
        last = write_machine(spark, part, window)
        docs = keep_rows(docs, text, clean_of(last, window))
    return docs


def clean_of(folder: str, window: int) -> Callable[[], Callable[[list[bytes]], np.ndarray]]:
    """Makes, on the executors, what tells texts without any window."""

    def make() -> Callable[[list[bytes]], np.ndarray]:
        from glimmer.llm.decontaminate import automaton as of

        machine = of(folder, window)
        return lambda texts: np.array([not runs for _, runs, _ in machine.scan(texts)], dtype=bool)

    return make
