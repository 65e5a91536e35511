"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of up to ORDER bytes counts which bytes follow. A byte's code length under a
context that has followed n times with d different bytes is -log2(c / (n + d)) if the byte followed c times; if it never
did, an escape of -log2(d / (n + d)) is paid and the next shorter context decides; after the empty one every byte takes
eight bits. Contexts that a language has not seen cost it nothing and pass on. Each text begins after ORDER zero bytes.
Statistics are frozen before scoring, so a text's code length in a language is the exact sum over its bytes, and the
language with the least (on ties the first by name) is the prediction. Its score is its share of the likelihood.

The classifier is fitted on a bounded sample: of the MOST_LANGS languages with the most text, whole documents of at most a
language's share (EACH_BYTES, and LEARN_BYTES for all), those with the least hash of the identifier, until the share is
full. Counts are made and summed by Spark; only the sample's distinct grams, at most as many as its bytes, reach the
driver. All texts are scored whole.

Null texts and texts without a letter (Unicode's) are `und` with score 0, and so are all if nothing was learned. Documents
without language or identifier are scored, never learned from. Repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glimmer.llm.common import from_npy, npy, quoted, ship, slices, stage, to_batch, trim

#: Bytes of the longest context.
ORDER = 4
#: Bytes of the sample, of a language's share of it, and languages that are learned, at most.
LEARN_BYTES, EACH_BYTES, MOST_LANGS = 2 << 20, 256 << 10, 32
#: Bytes that are scored together.
TOGETHER = 1 << 17

UNKNOWN = "und"


def buffer(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after another, each after ORDER zero bytes; and where each one's zeros begin and its bytes begin."""
    joined = np.frombuffer(b"".join(part for x in texts for part in (bytes(ORDER), x)) or bytes(1), dtype=np.uint8)
    sizes = np.array([len(x) for x in texts], dtype=np.int64) + ORDER
    starts = np.cumsum(sizes) - sizes
    return joined, np.stack([starts, starts + ORDER], axis=1).ravel()


def grams(data: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Of each place from start to stop the last ORDER + 1 bytes as one number, the newest in its lowest byte."""
    found = np.zeros(stop - start, dtype=np.uint64)
    for back in range(min(ORDER, stop - 1), -1, -1):
        skip = max(0, back - start)
        found[skip:] |= data[start + skip - back : stop - back].astype(np.uint64) << np.uint64(8 * back)
    return found


def low(keys: np.ndarray, n: int) -> np.ndarray:
    """The lowest n bytes."""
    return keys & np.uint64((1 << 8 * n) - 1)


class Lookup:
    """Finds numbers among distinct keys by open addressing."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(len(keys) * 4 - 1).bit_length()) if len(keys) else 4
        self.slots, self.keys = np.full(1 << self.bits, -1, dtype=np.int32), np.append(keys, np.uint64(0))
        open_, at = np.arange(len(keys)), self.first(keys)
        while len(open_):
            free = self.slots[at] < 0
            self.slots[at[free]] = open_[free]
            lost = self.slots[at] != open_
            open_, at = open_[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each among the keys, -1 where it is none."""
        at = self.first(wanted)
        found = self.slots[at]
        wrong = np.flatnonzero((found >= 0) & (self.keys[found] != wanted))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & ((1 << self.bits) - 1)
            found[wrong] = self.slots[at[wrong]]
            again = found[wrong]
            wrong = wrong[(again >= 0) & (self.keys[again] != wanted[wrong])]
        return found


def compiled(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> dict[str, np.ndarray]:
    """The frozen model from each language's (grams of ORDER + 1 bytes, how often): for each order the grams that any
    language has seen with their code lengths in each (bits), and the contexts with their escapes."""
    model: dict[str, np.ndarray] = {"langs": np.array(list(counts), dtype=np.str_)}
    before_keys, before = np.zeros(1, dtype=np.uint64), np.full((1, len(counts)), 8.0)
    for order in range(ORDER + 1):
        own = []
        for keys, times in counts.values():
            seen, back = np.unique(low(keys, order + 1), return_inverse=True)
            c = np.bincount(back, weights=times, minlength=len(seen))
            contexts, back = np.unique(seen >> np.uint64(8), return_inverse=True)
            own.append((seen, c, contexts, np.bincount(back, weights=c), np.bincount(back)))
        union, contexts = np.unique(np.concatenate([x[0] for x in own])), np.unique(np.concatenate([x[2] for x in own]))
        bits = before[np.searchsorted(before_keys, low(union, order))]
        escapes = np.zeros((len(contexts), len(counts)))
        for i, (seen, c, mine, n, d) in enumerate(own):
            escapes[np.searchsorted(contexts, mine), i] = np.log2((n + d) / d)
            at = np.minimum(np.searchsorted(mine, union >> np.uint64(8)), len(mine) - 1)
            bits[:, i] += np.where(mine[at] == union >> np.uint64(8), np.log2((n + d) / d)[at], 0)
            at = np.searchsorted(mine, seen >> np.uint64(8))
            bits[np.searchsorted(union, seen), i] = np.log2((n + d)[at] / c)
        model |= {f"grams{order}": union, f"bits{order}": bits, f"contexts{order}": contexts, f"escapes{order}": escapes}
        before_keys, before = union, bits
    return model


class Model:
    """The frozen statistics of all languages."""

    def __init__(self, model: dict[str, np.ndarray]) -> None:
        self.langs = [str(x) for x in model["langs"]]
        self.levels = [(Lookup(model[f"grams{k}"]), model[f"bits{k}"], Lookup(model[f"contexts{k}"]), model[f"escapes{k}"]) for k in range(ORDER + 1)]

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): each text's code length in bits."""
        data, edges = buffer(texts)
        total = np.zeros((len(edges), len(self.langs)))
        for start in range(0, len(data) if texts else 0, TOGETHER):
            stop = min(start + TOGETHER, len(data))
            costs = self.costs(grams(data, start, stop))
            a, b = int(np.searchsorted(edges, start, side="right")) - 1, int(np.searchsorted(edges, stop))
            cuts = np.maximum(edges[a:b] - start, 0)
            # an edge that another one shares (an empty text) adds nothing
            real = np.flatnonzero(np.append(cuts[1:] > cuts[:-1], True))
            for i in range(len(self.langs)):
                total[a + real, i] += np.add.reduceat(costs[:, i], cuts[real])
        return total[1::2]

    def costs(self, keys: np.ndarray) -> np.ndarray:
        """Each place's code length in each language."""
        costs, rest = None, None
        for order in range(ORDER, -1, -1):
            grams_, bits, contexts, escapes = self.levels[order]
            at = grams_(low(keys, order + 1))
            missing = np.flatnonzero(at < 0)
            if costs is None:
                costs = bits[at]
                rest, costs[missing] = missing, 0
            else:
                costs[rest] += np.where((at < 0)[:, None], 0, bits[at])
                rest = rest[missing]
            if not len(rest):
                return costs
            keys = keys[missing]
            at = contexts(low(keys >> np.uint64(8), order))
            costs[rest] += np.where((at < 0)[:, None], 0, escapes[at])
        costs[rest] += 8
        return costs


def learned(docs: DataFrame, learns: Callable[[Column], Column], key: str, text: str, lang: str) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Each learned language's grams and how often they occur in its sample."""
    doc = F.col(quoted(key)).cast("long")
    size = F.octet_length(F.col(quoted(text)).cast("string"))
    rows = docs.select(doc.alias("doc"), F.col(quoted(lang)).cast("string").alias("lang"), F.col(quoted(text)).cast("string").alias("text"), size.alias("size"))
    rows = rows.where(F.col("lang").isNotNull() & F.coalesce(learns(F.col("doc")), F.lit(False)) & F.col("size").between(1, EACH_BYTES))
    sizes = rows.groupBy("lang").agg(F.sum("size").alias("bytes")).orderBy(F.desc("bytes"), "lang").limit(MOST_LANGS).collect()
    if not sizes:
        return {}
    share = min(EACH_BYTES, LEARN_BYTES // len(sizes))
    chances = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 4 * share / r["bytes"])) for r in sizes], "lang string, chance double")
    lot = F.xxhash64(F.lit(1), "doc")
    some = rows.join(F.broadcast(chances), "lang").where((lot / F.lit(2.0**64) + 0.5) < F.col("chance"))  # some four shares at most
    some = stage(some.select("lang", "text", "size", lot.alias("lot")), "language-sample")
    order = Window.partitionBy("lang").orderBy("lot", "size", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, -1)
    taken = some.withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0))).where((F.col("before") < share) & (F.col("size") <= share)).select("lang", "text")
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            names = np.array(batch.column(0).to_pylist())
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for name in np.unique(names):
                data, edges = buffer([x for x, y in zip(texts, names, strict=True) if y == name])
                zeros = (edges[::2, None] + np.arange(ORDER)).ravel()
                found, times = np.unique(np.delete(grams(data, 0, len(data)), zeros), return_counts=True)
                yield to_batch({"lang": [str(name)] * len(found), "gram": found.view(np.int64), "n": times}, schema)

    summed = taken.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names, keys, times = np.array(summed["lang"].to_pylist()), summed["gram"].to_numpy().view(np.uint64), summed["n"].to_numpy()
    return {str(x): (keys[names == x], times[names == x]) for x in sorted(set(names.tolist()))}


def identify(docs: DataFrame, learns: Callable[[Column], Column], key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, lang_pred, score, bits double: the code length in the predicted language, null for `und`). learns: of the
    identifier, whether the document may be learned from."""
    spark = docs.sparkSession
    ship(spark)
    counts = learned(docs, learns, key, text, lang)
    held = spark.sparkContext.broadcast(npy(**compiled(counts))) if counts else None
    schema = pa.schema([("doc", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("bits", pa.float64())])
    worded = F.coalesce(F.col(quoted(text)).cast("string").rlike(r"\p{L}"), F.lit(False))
    plain = docs.select(F.col(quoted(key)).cast("long").alias("doc"), F.when(worded, F.col(quoted(text)).cast("string")).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(from_npy(held.value)) if held else None
        for batch in slices(batches, 1 << 20):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            n = len(texts)
            if model is None:
                yield to_batch({"doc": batch.column(0), "lang_pred": [UNKNOWN] * n, "score": [0.0] * n, "bits": [None] * n}, schema)
                continue
            bits = model.lengths([x or b"" for x in texts])
            best = bits.argmin(axis=1)
            least = bits[np.arange(n), best]
            scores = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
            none = np.array([x is None for x in texts], dtype=bool)
            yield to_batch({"doc": batch.column(0), "lang_pred": [UNKNOWN if x is None else model.langs[i] for x, i in zip(texts, best.tolist(), strict=True)], "score": np.where(none, 0.0, scores), "bits": pa.array(least, mask=none)}, schema)

    return plain.mapInArrow(run, "doc long, lang_pred string, score double, bits double").withColumnRenamed("doc", key)
