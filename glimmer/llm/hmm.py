"""Language-model scores by a hidden Markov model, beside an add-one unigram base.

Tokens are words in lower case and one end for each text. Tasks turn their texts into blocks: the distinct words of the
block and the texts as numbers of these words; the texts themselves are not moved. Blocks send a row for each of their
distinct words; rows meet by word, are summed over all training texts, and go back to their blocks, so a frequent word
costs one row for each block rather than for each occurrence.

The model's states emit classes of words: each frequent word is a class of its own, all others share classes by a hash,
in which a word has its share of the class's counts, and unknown words together the share of one more word. Baum-Welch
runs over all training texts by the exact forward-backward recursion over whole texts: the forward states at the ends of
segments are kept, those inside are computed again on the way back. Each pass sums expected counts over all tasks, dealt
by state and range of classes. The score of a text is the exact logarithm of its probability: the forward recursion over
the whole text, scaled at each token, plus the words' shares of their classes.

Null or empty texts are one end token. A null identifier belongs to the training texts. Rows that repeat an identifier
each count as a text. Without any training text all probabilities are those of the smoothing alone.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glimmer.llm.common import count_blocks, from_npy, npy, pack, quoted, ship, slices, stage, to_batch, unpack

#: Bytes of text in a block.
BLOCK_BYTES = 8 << 20
#: Counts below this have a bin of their own in the histogram of counts; above, there are 16 bins for each doubling.
EXACT = 1024
#: Bytes that the words with classes of their own have at most in all.
MOST_WORD_BYTES = 8 << 20
#: Tokens of a segment, whose forward states are held at once, and of the blocks that run together.
SEGMENT, TOGETHER = 1 << 18, 2 << 20
#: The word that stands for the end.
END = b""


@dataclass(frozen=True)
class Shape:
    """states; words: the most classes of single words; shared: the classes of all other words; passes: of Baum-Welch;
    smoothing: counts that are spread over each state's classes as they are distributed in all; seed: of the start."""

    states: int = 8
    words: int = 20_000
    shared: int = 2_000
    passes: int = 8
    smoothing: float = 50.0
    seed: int = 11


BLOCK_DDL = "block long, n long, words binary, n_bytes long, counts binary, n_tokens long, width int, tokens binary, n_docs long, docs binary, nulls binary, sizes binary, held binary"
BLOCK = pa.schema([
    ("block", pa.int64()), ("n", pa.int64()), ("words", pa.binary()), ("n_bytes", pa.int64()), ("counts", pa.binary()), ("n_tokens", pa.int64()), ("width", pa.int32()), ("tokens", pa.binary()),
    ("n_docs", pa.int64()), ("docs", pa.binary()), ("nulls", pa.binary()), ("sizes", pa.binary()), ("held", pa.binary()),
])
SCORED = pa.schema([
    ("block", pa.int64()), ("n_tokens", pa.int64()), ("classes", pa.binary()), ("n_docs", pa.int64()), ("docs", pa.binary()), ("nulls", pa.binary()), ("sizes", pa.binary()), ("held", pa.binary()),
    ("known", pa.binary()), ("base", pa.binary()), ("inner", pa.binary()),
])
SCORED_DDL = "block long, n_tokens long, classes binary, n_docs long, docs binary, nulls binary, sizes binary, held binary, known binary, base binary, inner binary"
#: Begins what is hashed into the shared classes.
SHARED = b"\x01"


def joined(words: list[bytes]) -> tuple[bytes, int]:
    blob = b"\n".join(words)
    return pack(np.frombuffer(blob, dtype=np.uint8)), len(blob)


def parted(blob: bytes, size: int, n: int) -> list[bytes]:
    return unpack(blob, size, np.uint8).tobytes().split(b"\n") if n else []


def block_row(block: int, ids: list[int | None], held: list[bool], texts: list[bytes]) -> dict:
    """A block: its distinct words with their counts in training texts, and its texts as numbers of these words."""
    number: dict[bytes, int] = defaultdict(count().__next__)
    parts, sizes = [], []
    for text in texts:
        words = text.lower().split()
        words.append(END)
        parts.append(np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words)))
        sizes.append(len(words))
    tokens = np.concatenate(parts)
    train = np.repeat(~np.array(held, dtype=bool), sizes)
    counts = np.bincount(tokens[train], minlength=len(number))
    blob, n_bytes = joined(list(number))
    kind = np.uint16 if len(number) < 1 << 16 else np.uint32
    return {
        "block": block, "n": len(number), "words": blob, "n_bytes": n_bytes, "counts": pack(counts), "n_tokens": len(tokens), "width": np.dtype(kind).itemsize, "tokens": pack(tokens.astype(kind)),
        "n_docs": len(ids), "docs": pack(np.array([x or 0 for x in ids], dtype=np.int64)), "nulls": pack(np.array([x is None for x in ids], dtype=np.uint8)), "sizes": pack(np.array(sizes, dtype=np.int64)), "held": pack(np.array(held, dtype=np.uint8)),
    }


def to_blocks(docs: DataFrame, key: str, text: str, held: Column) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        ids, outs, texts, size, number = [], [], [], 0, 0
        for batch in slices(batches):
            ids += batch.column(0).to_pylist()
            texts += batch.column(1).cast(pa.binary()).to_pylist()
            outs += batch.column(2).to_pylist()
            size += batch.nbytes
            if size >= BLOCK_BYTES:
                yield pa.RecordBatch.from_pylist([block_row(first + number, ids, outs, texts)], schema=BLOCK)
                ids, outs, texts, size, number = [], [], [], 0, number + 1
        if ids:
            yield pa.RecordBatch.from_pylist([block_row(first + number, ids, outs, texts)], schema=BLOCK)

    plain = docs.select(F.col(quoted(key)).cast("long").alias("doc"), F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")).alias("text"), held.alias("held"))
    return plain.mapInArrow(run, BLOCK_DDL)


def word_rows(blocks: DataFrame) -> DataFrame:
    """(word, count, block, place) of the distinct words of each block."""
    schema = pa.schema([("word", pa.binary()), ("count", pa.int64()), ("block", pa.int64()), ("place", pa.int32())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                words, counts = parted(r["words"], r["n_bytes"], r["n"]), unpack(r["counts"], r["n"], np.int64)
                for at in range(0, len(words), 1 << 15):
                    own = words[at : at + (1 << 15)]
                    yield to_batch({"word": own, "count": counts[at : at + len(own)], "block": np.full(len(own), r["block"]), "place": np.arange(at, at + len(own), dtype=np.int32)}, schema)

    return blocks.select("block", "n", "words", "n_bytes", "counts").mapInArrow(run, "word binary, count long, block long, place int")


def summed_counts(rows: DataFrame, parts: int) -> DataFrame:
    """(block, place, total, word): the word's count in all training texts, for each block; the word stands in one of
    its rows only."""
    dealt = rows.repartition(parts, "word")
    sums = dealt.groupBy("word").agg(F.sum("count").alias("total"), F.min("block").alias("first"))
    met = dealt.join(sums.hint("shuffle_hash"), "word")  # a part holds a bounded share of the words, already in place
    return met.select("block", "place", "total", F.when(F.col("block") == F.col("first"), F.col("word")).alias("word"))


def bin_of(n: Column) -> Column:
    """The bin of a count in the histogram: exact up to EXACT, then 16 for each doubling."""
    return F.when(n < EXACT, n).otherwise(EXACT + F.floor(16 * F.log2(n / EXACT))).cast("long")


def frequent_words(vocabulary: DataFrame, most: int) -> dict[bytes, int]:
    """Words and counts of all words with at least the least count (by bins) that leaves at most so many, of at most
    MOST_WORD_BYTES in all; words that occur once are never among them, END always."""
    sized = vocabulary.where(F.col("word") != F.lit(END)).withColumn("bin", bin_of(F.col("total")))
    bins = sized.groupBy("bin").agg(F.count("*").alias("n"), F.sum(F.octet_length("word")).alias("size")).collect()  # bounded by the bins
    least, held, size = 1 << 62, 0, 0
    for r in sorted(bins, key=lambda r: -r["bin"]):
        held, size = held + r["n"], size + r["size"]
        if held > most or size > MOST_WORD_BYTES or r["bin"] < 2:
            break
        least = r["bin"]
    rows = vocabulary.where((F.col("word") == F.lit(END)) | (bin_of(F.col("total")) >= least)).select("word", "total").collect()
    return {w: n for w, n in sorted((bytes(r["word"]), r["total"]) for r in rows)}


class Model:
    """start, move and emit as probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.move, self.emit = (x.astype(np.float64) for x in (start, move, emit))

    def blob(self) -> bytes:
        return npy(start=self.start, move=self.move, emit=self.emit)


class Lanes:
    """Texts side by side, the longest first: order (of the texts), active (how many reach each step), and the classes of
    one step after another; those of a step are classes[edges[step] : edges[step + 1]]."""

    def __init__(self, classes: np.ndarray, sizes: np.ndarray) -> None:
        self.order = np.argsort(-sizes, kind="stable")
        active = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(int(sizes.max())), side="right")
        self.active, self.edges = active.tolist(), np.r_[0, np.cumsum(active)].tolist()
        lane = np.empty(len(sizes), dtype=np.int64)
        lane[self.order] = np.arange(len(sizes))
        steps = np.arange(len(classes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.classes = np.empty(len(classes), dtype=np.int32)
        self.classes[np.asarray(self.edges)[steps] + np.repeat(lane, sizes)] = classes

    def at(self, step: int) -> np.ndarray:
        return self.classes[self.edges[step] : self.edges[step + 1]]


def log_likelihoods(classes: np.ndarray, sizes: np.ndarray, model: Model) -> np.ndarray:
    """log10 of the probability of each text's classes, by the scaled forward recursion."""
    lanes = Lanes(classes, sizes)
    emit, ones = np.ascontiguousarray(model.emit.T), np.ones((len(model.start), 1))
    held, out = np.broadcast_to(model.start, (len(sizes), len(model.start))), np.zeros(len(sizes))
    for step, n in enumerate(lanes.active):
        held = (held[:n] @ model.move if step else held[:n]) * emit.take(lanes.at(step), axis=0)
        scale = held @ ones
        held /= scale
        out[:n] += np.log10(scale[:, 0])
    found = np.empty_like(out)
    found[lanes.order] = out
    return found


def expected_counts(classes: np.ndarray, sizes: np.ndarray, model: Model, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of (start, move, emit) over whole texts. Steps fall into segments of about so many tokens; the
    forward states at their starts are kept, and those within a segment computed again when the way back reaches it."""
    k, n_classes = model.emit.shape
    lanes = Lanes(classes, sizes)
    emit, move, ones = np.ascontiguousarray(model.emit.T).astype(np.float32), model.move.astype(np.float32), np.ones((k, 1), dtype=np.float32)
    back_move = np.ascontiguousarray(move.T)
    edges, n_lanes = lanes.edges, len(sizes)
    cuts = [0, *(np.flatnonzero(np.diff(np.array(edges[1:]) // segment)) + 1).tolist(), len(lanes.active)]
    most = max(edges[b] - edges[a] for a, b in zip(cuts, cuts[1:], strict=False))
    # buffers that all steps share: the states and scales of a segment, and what a step needs besides
    states, scales = np.empty((most, k), dtype=np.float32), np.empty((most, 1), dtype=np.float32)
    moved, seen, later = (np.empty((n_lanes, k), dtype=np.float32) for _ in range(3))

    def ahead(a: int, b: int, held: np.ndarray) -> np.ndarray:
        """The states of the steps from a to b, scaled, in the buffers; a copy of the last ones."""
        for step in range(a, b):
            n, own = lanes.active[step], slice(edges[step] - edges[a], edges[step + 1] - edges[a])
            np.take(emit, lanes.at(step), axis=0, out=seen[:n], mode="clip")
            if step:
                held = np.matmul(held[:n], move, out=moved[:n])
            held = np.multiply(held, seen[:n], out=states[own])
            scale = np.matmul(held, ones, out=scales[own])
            np.reciprocal(scale, out=scale)
            held *= scale
        return held.copy()

    starts = [np.broadcast_to(model.start.astype(np.float32), (n_lanes, k))]
    for a, b in zip(cuts[:-2], cuts[1:-1], strict=True):
        starts.append(ahead(a, b, starts[-1]))
    moves, emits, start, m = np.zeros((k, k)), np.zeros((k, n_classes)), np.zeros(k), 0
    for a, b in reversed(list(zip(cuts[:-1], cuts[1:], strict=True))):
        ahead(a, b, starts.pop())
        for step in range(b - 1, a - 1, -1):
            n, part = lanes.active[step], slice(edges[step] - edges[a], edges[step + 1] - edges[a])
            own = states[part]
            np.take(emit, lanes.at(step), axis=0, out=seen[:n], mode="clip")
            seen[:n] *= scales[part]
            if m:  # lanes that go on behind this step
                moves += own[:m].T @ later[:m]
                back = np.matmul(later[:m], back_move, out=moved[:m])
                own[:m] *= back  # from here on the weight of each state
                seen[:m] *= back
            seen, later, m = later, seen, n
        which = lanes.classes[edges[a] : edges[b]]
        for i in range(k):
            emits[i] += np.bincount(which, weights=states[: len(which), i], minlength=n_classes)
        start = states[: lanes.active[a]].sum(axis=0, dtype=np.float64)
    return start, model.move * moves, emits


def first_model(shape: Shape, overall: np.ndarray) -> Model:
    """States that emit what is common, each with weights of its own, and mostly stay."""
    random = np.random.default_rng(shape.seed)
    k = shape.states
    emit = overall * np.exp(random.normal(scale=1.0, size=(k, len(overall))))
    move = np.full((k, k), 0.1 / max(1, k - 1))
    np.fill_diagonal(move, 0.9 if k > 1 else 1.0)
    return Model(np.full(k, 1 / k), move, emit / emit.sum(axis=1, keepdims=True))


def training_texts(rows: Iterable[dict]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(classes, sizes) of the training texts of blocks, several blocks together up to a number of tokens."""
    held, lengths, size = [], [], 0
    for r in rows:
        sizes = unpack(r["sizes"], r["n_docs"], np.int64)
        train = unpack(r["held"], r["n_docs"], np.uint8) == 0
        if not train.any():
            continue
        held.append(unpack(r["classes"], r["n_tokens"], np.uint16)[np.repeat(train, sizes)])
        lengths.append(sizes[train])
        size += len(held[-1])
        if size >= TOGETHER:
            yield np.concatenate(held), np.concatenate(lengths)
            held, lengths, size = [], [], 0
    if held:
        yield np.concatenate(held), np.concatenate(lengths)


def one_pass(scored: DataFrame, model: Model, overall: np.ndarray, smoothing: float, parts: int = 8) -> Model:
    """A pass of Baum-Welch over all training texts. Each task sums its own; sums of a state and a range of classes meet
    in one place, one after another."""
    k, n_classes = model.emit.shape
    held = scored.sparkSession.sparkContext.broadcast(model.blob())
    cuts = np.linspace(0, n_classes, parts + 1).astype(int).tolist()

    def expect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(**from_npy(held.value))
        small, emits = np.zeros((k, k + 1)), np.zeros((k, n_classes))
        for classes, sizes in training_texts(r for batch in batches for r in batch.to_pylist()):
            start, move, emit = expected_counts(classes, sizes, own)
            small += np.c_[start, move]
            emits += emit
        rows = [(i, -1, small[i]) for i in range(k)] + [(i, j, emits[i, a:b]) for i in range(k) for j, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in rows], type=pa.int32()), pa.array([j for _, j, _ in rows], type=pa.int32()), pa.array([x.tobytes() for _, _, x in rows], type=pa.binary())], names=["state", "part", "sums"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for i, j, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(x)
                sums[i, j] = sums[i, j] + x if (i, j) in sums else x
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in sums], type=pa.int32()), pa.array([j for _, j in sums], type=pa.int32()), pa.array([x.tobytes() for x in sums.values()], type=pa.binary())], names=["state", "part", "sums"])

    ddl = "state int, part int, sums binary"
    rows = scored.select("n_tokens", "classes", "n_docs", "sizes", "held").mapInArrow(expect, ddl).repartition(k * parts, "state", "part").mapInArrow(add, ddl).collect()  # of fixed size
    small, emits = np.zeros((k, k + 1)), np.zeros((k, n_classes))
    for r in rows:
        if r["part"] < 0:
            small[r["state"]] = np.frombuffer(r["sums"])
        else:
            emits[r["state"], cuts[r["part"]] : cuts[r["part"] + 1]] = np.frombuffer(r["sums"])
    start, move = small[:, 0] + 1, small[:, 1:] + 1
    emits = emits + smoothing * overall
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emits / emits.sum(axis=1, keepdims=True))


def score_texts(docs: DataFrame, held: Callable[[Column], Column], shape: Shape = Shape(), key: str = "doc_id", text: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row. held: of the identifier,
    whether the text is kept from training; null counts as not."""
    if shape.words + shape.shared + 1 >= 1 << 16:
        raise ValueError("there are too many classes")
    ship(docs.sparkSession)
    spark = docs.sparkSession
    parts = count_blocks(docs, block_bytes, text=text)
    blocks = stage(to_blocks(docs, key, text, F.coalesce(held(F.col(quoted(key))), F.lit(False))), "blocks")
    counts = stage(summed_counts(word_rows(blocks), parts), "counts")
    vocabulary = counts.where("word is not null and total > 0").select("word", "total")
    shared_class = (F.crc32(F.concat(F.lit(SHARED), F.col("word"))) % shape.shared).cast("int")
    weights = np.ones(shape.shared, dtype=np.int64)  # one more word in each: the unknown ones
    total = known = 0
    for r in vocabulary.groupBy(shared_class.alias("class")).agg(F.sum("total").alias("tokens"), F.count("*").alias("words")).collect():  # a row a class
        weights[r["class"]] += r["tokens"] + r["words"]
        total, known = total + r["tokens"], known + r["words"]
    top = frequent_words(vocabulary, shape.words)
    for word, n in top.items():
        weights[zlib.crc32(SHARED + word) % shape.shared] -= n + 1
    ends = top.pop(END, 0)
    n_top = 1 + len(top)
    overall = np.r_[1.0 + ends, np.array(list(top.values()), dtype=np.float64) + 1, weights.astype(np.float64)]
    overall /= overall.sum()
    names = spark.sparkContext.broadcast({word: i + 1 for i, word in enumerate(top)} | {END: 0})
    n_shared, denominator = shape.shared, float(np.log10(total + known + 1))
    shares = np.log10(weights)

    def classify(key: tuple, blocks: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for r in blocks.to_pylist():
            words = parted(r["words"], r["n_bytes"], r["n"])
            counts = np.zeros(len(words), dtype=np.int64)
            counts[answers.column("place").to_numpy()] = answers.column("total").to_numpy()
            number = np.fromiter((names.value.get(w, -1) for w in words), dtype=np.int64, count=len(words))
            rare = number < 0
            number[rare] = n_top + np.fromiter((zlib.crc32(SHARED + w) % n_shared for w, x in zip(words, rare.tolist(), strict=True) if x), dtype=np.int64, count=int(rare.sum()))
            logs = np.log10(counts + 1.0)
            inner = np.where(rare, logs - shares[np.maximum(number - n_top, 0)], 0.0)
            tokens = unpack(r["tokens"], r["n_tokens"], np.uint16 if r["width"] == 2 else np.uint32).astype(np.int64)
            sizes = unpack(r["sizes"], r["n_docs"], np.int64)
            begin = np.cumsum(sizes) - sizes
            out.append({
                "block": r["block"], "n_tokens": r["n_tokens"], "classes": pack(number[tokens].astype(np.uint16)), "n_docs": r["n_docs"], **{c: r[c] for c in ("docs", "nulls", "sizes", "held")},
                "known": pack(np.add.reduceat((counts > 0)[tokens].astype(np.int64), begin)), "base": pack(np.add.reduceat(logs[tokens], begin) - sizes * denominator), "inner": pack(np.add.reduceat(inner[tokens], begin)),
            })
        return pa.Table.from_pylist(out, schema=SCORED)

    own, back = (x.repartition(parts, "block").groupBy("block") for x in (blocks.drop("counts"), counts.select("block", "place", "total")))
    scored = stage(own.cogroup(back).applyInArrow(classify, SCORED_DDL), "classes")
    model = first_model(shape, overall)
    for _ in range(shape.passes):
        model = one_pass(scored, model, overall, shape.smoothing)
    final = spark.sparkContext.broadcast(model.blob())
    train_tokens = int(total)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(**from_npy(final.value))
        for batch in batches:
            for r in batch.to_pylist():
                n = r["n_docs"]
                ids, sizes, nulls = unpack(r["docs"], n, np.int64), unpack(r["sizes"], n, np.int64), unpack(r["nulls"], n, np.uint8) > 0
                classes = unpack(r["classes"], r["n_tokens"], np.uint16).astype(np.int64)
                likely = log_likelihoods(classes, sizes, own) + unpack(r["inner"], n, np.float64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=nulls), pa.array(unpack(r["held"], n, np.uint8) > 0), pa.array(sizes), pa.array(unpack(r["known"], n, np.int64)), pa.array(np.full(n, train_tokens)), pa.array(unpack(r["base"], n, np.float64)), pa.array(likely)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return scored.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
