"""Toxicity scores from a bidirectional gated recurrent network in numpy.

A text is read as words of letters, in lower case. A gated recurrent network reads each word's bytes in both
directions; its last states, joined with an embedding of the word by hash, are the inputs of a second such network over
the words of a window. Attention pools the window's states into one logit. A text is scored by all its windows of WINDOW
words that begin every STRIDE words, and one that ends with it; each overlaps the next by three quarters, so a passage of
up to 25 words lies whole in a window. The highest score counts.

Training takes a bounded sample: at most `docs_each` labelled texts of each class, those with the least hash of the
identifier, each with all the windows that scoring takes; of these, texts over LEARN_BYTES are not learned from. It runs in rounds of a fixed number of steps, whatever the sample's size; texts are
drawn in turn. In the first round every window takes the label of its text. Before each later round all windows of the
sample are scored: a toxic text then stands for its highest window, as most others hold nothing toxic, and half of the
harmless windows of a step are drawn in proportion to their scores. Scoring covers all windows of all texts. A text
without words scores zero. Null labels are left out; without labels of both classes all scores are zero. Texts with a null
identifier are scored but never trained on.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glimmer.llm.common import documents, from_npy, keep_rows, npy, ship, slices

#: Labelled texts of each class that are learned from, unless the caller says otherwise.
DOCS_EACH = 1500
#: Rounds of training, steps in a round, and windows of either class in a step.
ROUNDS, STEPS, EACH = 8, 150, 24
#: Words in a window, and from one window's start to the next.
WINDOW, STRIDE = 32, 8
#: Bytes of a text that is learned from at most.
LEARN_BYTES = 256 << 10
#: Bytes of a word that are read together; longer words are cut into such pieces, inside a character if it falls so.
LONGEST = 24
#: Sizes: of byte and word embeddings, of the states over bytes and words, of the attention, and of the table of words.
BYTES, WORDS, CHAR, STATE, ATTEND, TABLE = 12, 8, 12, 12, 12, 4096
#: Windows that run together.
TOGETHER = 4096

#: Of each byte: letters in lower case and bytes beyond ASCII stay, all else separates.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def tokens(text: bytes) -> list[bytes]:
    words = text.translate(FOLD).split()
    if len(text) > LONGEST and any(len(w) > LONGEST for w in words):
        return [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]
    return words


def window_starts(n: int) -> list[int]:
    """Of a text of n words; the last window ends with the text."""
    if n <= WINDOW:
        return [0] if n else []
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Gru:
    """A gated recurrent layer over steps; its parameters are w (inputs), u (states) and b in a shared table."""

    def __init__(self, params: dict[str, np.ndarray], name: str) -> None:
        self.params, self.name = params, name

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(self.params[f"{self.name}_{x}"] for x in "wub")

    def forward(self, inputs: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """States (steps, rows, size) from inputs (steps, rows, width); where mask is 0 a state is carried on."""
        w, u, b = self.parts()
        size = u.shape[0]
        held, out, self.kept = np.zeros((inputs.shape[1], size), dtype=np.float32), [], []
        given = inputs @ w + b
        for step in range(len(inputs)):
            own = held @ u
            gates = sigmoid(given[step][:, : 2 * size] + own[:, : 2 * size])
            reset, keep = gates[:, :size], gates[:, size:]
            new = np.tanh(given[step][:, 2 * size :] + reset * own[:, 2 * size :])
            after = new + keep * (held - new)
            m = mask[step][:, None]
            self.kept.append((held, reset, keep, new, own[:, 2 * size :], m))
            held = m * after + (1 - m) * held
            out.append(held)
        self.inputs = inputs
        return np.stack(out)

    def backward(self, slope: np.ndarray, grads: dict[str, np.ndarray]) -> np.ndarray:
        """The slope by inputs; adds those by parameters to grads."""
        w, u, _ = self.parts()
        size = u.shape[0]
        later, given = np.zeros_like(slope[0]), np.empty((*slope.shape[:2], 3 * size), dtype=np.float32)
        du = np.zeros_like(u)
        for step in range(len(slope) - 1, -1, -1):
            held, reset, keep, new, own, m = self.kept[step]
            total = slope[step] + later
            after = total * m
            d_new = after * (1 - keep) * (1 - new * new)
            d_keep = after * (held - new) * keep * (1 - keep)
            d_reset = d_new * own * reset * (1 - reset)
            given[step] = np.concatenate([d_reset, d_keep, d_new], axis=1)
            d_own = np.concatenate([d_reset, d_keep, d_new * reset], axis=1)
            du += held.T @ d_own
            later = total * (1 - m) + after * keep + d_own @ u.T
        flat = given.reshape(-1, 3 * size)
        grads[f"{self.name}_w"] += self.inputs.reshape(-1, self.inputs.shape[2]).T @ flat
        grads[f"{self.name}_u"] += du
        grads[f"{self.name}_b"] += flat.sum(axis=0)
        return given @ w.T


def padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes as (steps, words), and which of them are there."""
    sizes = np.array([len(w) for w in words])
    steps = int(sizes.max()) if len(words) else 1
    found = np.frombuffer(b"".join(w.ljust(steps, b"\0") for w in words), dtype=np.uint8).reshape(len(words), steps).T
    return found, (np.arange(steps)[:, None] < sizes).astype(np.float32)


class Network:
    """The network; params holds all its arrays by name."""

    LAYERS = (("char_ahead", BYTES, CHAR), ("char_back", BYTES, CHAR), ("word_ahead", 2 * CHAR + WORDS, STATE), ("word_back", 2 * CHAR + WORDS, STATE))

    def __init__(self, params: dict[str, np.ndarray]) -> None:
        self.params = params
        self.layers = {name: Gru(params, name) for name, _, _ in self.LAYERS}

    @classmethod
    def fresh(cls, seed: int = 7) -> Network:
        random = np.random.default_rng(seed)

        def some(*shape: int, scale: float | None = None) -> np.ndarray:
            return (random.normal(size=shape) * (scale or shape[0] ** -0.5)).astype(np.float32)

        params = {"bytes": some(256, BYTES, scale=0.5), "words": some(TABLE, WORDS, scale=0.05)}
        for name, width, size in cls.LAYERS:
            params |= {f"{name}_w": some(width, 3 * size), f"{name}_u": some(size, 3 * size), f"{name}_b": np.zeros(3 * size, dtype=np.float32)}
        params |= {"attend_w": some(2 * STATE, ATTEND), "attend_b": np.zeros(ATTEND, dtype=np.float32), "attend_v": some(ATTEND), "out_w": some(2 * STATE), "out_b": np.full(1, -1.0, dtype=np.float32)}
        return cls(params)

    def word_inputs(self, words: list[bytes]) -> np.ndarray:
        """A row for each word: the last states over its bytes, and its embedding."""
        found, mask = padded(words)
        self.bytes_at, self.bytes_mask = found, mask
        read = self.params["bytes"][found]
        ahead = self.layers["char_ahead"].forward(read, mask)[-1]
        back = self.layers["char_back"].forward(read[::-1], mask[::-1])[-1]
        self.table_at = np.fromiter((zlib.crc32(w) % TABLE for w in words), dtype=np.int64, count=len(words))
        return np.concatenate([ahead, back, self.params["words"][self.table_at]], axis=1)

    def logits(self, rows: np.ndarray, at: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Of windows given as numbers of rows (steps, windows)."""
        p = self.params
        self.at, self.mask, read = at, mask, rows[at]
        ahead = self.layers["word_ahead"].forward(read, mask)
        back = self.layers["word_back"].forward(read[::-1], mask[::-1])[::-1]
        self.states = np.concatenate([ahead, back], axis=2)
        self.attended = np.tanh(self.states @ p["attend_w"] + p["attend_b"])
        score = self.attended @ p["attend_v"] - 1e9 * (1 - mask)
        weight = np.exp(score - score.max(axis=0))
        self.weight = weight / weight.sum(axis=0)
        self.pooled = (self.weight[:, :, None] * self.states).sum(axis=0)
        return self.pooled @ p["out_w"] + p["out_b"][0]

    def backward(self, slope: np.ndarray, n_words: int) -> dict[str, np.ndarray]:
        """The slopes by all parameters from those by the logits of the last call."""
        p, grads = self.params, {k: np.zeros_like(v) for k, v in self.params.items()}
        grads["out_w"] += self.pooled.T @ slope
        grads["out_b"] += slope.sum()
        pooled = slope[:, None] * p["out_w"]
        d_states = self.weight[:, :, None] * pooled
        d_weight = (self.states * pooled).sum(axis=2)
        d_score = self.weight * (d_weight - (self.weight * d_weight).sum(axis=0))
        grads["attend_v"] += np.tensordot(d_score, self.attended, axes=([0, 1], [0, 1]))
        d_attended = d_score[:, :, None] * p["attend_v"] * (1 - self.attended**2)
        grads["attend_w"] += np.tensordot(self.states, d_attended, axes=([0, 1], [0, 1]))
        grads["attend_b"] += d_attended.sum(axis=(0, 1))
        d_states = (d_states + d_attended @ p["attend_w"].T).astype(np.float32)
        d_read = self.layers["word_ahead"].backward(d_states[:, :, :STATE], grads)
        d_read = d_read + self.layers["word_back"].backward(d_states[::-1, :, STATE:], grads)[::-1]
        d_rows = np.zeros((n_words, d_read.shape[2]), dtype=np.float32)
        np.add.at(d_rows, self.at.reshape(-1), (d_read * self.mask[:, :, None]).reshape(-1, d_read.shape[2]))
        np.add.at(grads["words"], self.table_at, d_rows[:, 2 * CHAR :])
        steps = len(self.bytes_at)
        last = np.zeros((steps, n_words, CHAR), dtype=np.float32)
        last[-1] = d_rows[:, :CHAR]
        d_bytes = self.layers["char_ahead"].backward(last, grads)
        last[-1] = d_rows[:, CHAR : 2 * CHAR]
        d_bytes = d_bytes + self.layers["char_back"].backward(last, grads)[::-1]
        np.add.at(grads["bytes"], self.bytes_at.reshape(-1), (d_bytes * self.bytes_mask[:, :, None]).reshape(-1, BYTES))
        return grads


def laid_out(windows: list[list[bytes]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words, and the windows as numbers of them (steps, windows) with their mask."""
    number: dict[bytes, int] = defaultdict(count().__next__)
    at, mask = np.zeros((WINDOW, len(windows)), dtype=np.int64), np.zeros((WINDOW, len(windows)), dtype=np.float32)
    for i, window in enumerate(windows):
        at[: len(window), i] = [number[w] for w in window]
        mask[: len(window), i] = 1
    return list(number), at, mask


def window_scores(network: Network, docs: list[tuple[int, list[list[bytes]]]]) -> np.ndarray:
    """The scores of all windows, one text after another."""
    windows, scorer = [b" ".join(w) for _, own in docs for w in own], Scorer(network.params)
    return np.concatenate([scorer.scores(windows[at : at + TOGETHER]) for at in range(0, len(windows), TOGETHER)])


def train(docs: list[tuple[int, list[list[bytes]]]], rounds: int = ROUNDS, steps: int = STEPS, rate: float = 0.02, each: int = EACH, seed: int = 7) -> Network | None:
    """docs: (label, windows); see the module's text."""
    docs = [x for x in docs if x[1]]
    bad, good = ([x for x in docs if x[0] == label] for label in (1, 0))
    if not bad or not good:
        return None
    network, random = Network.fresh(seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in network.params.items()}
    second = {k: np.zeros_like(v) for k, v in network.params.items()}
    labels = np.repeat([1.0, 0.0], each)
    harmless = [w for _, own in good for w in own]

    def any_window(own: list) -> Iterator[list[bytes]]:
        """A window of each text in a random order, again and again."""
        while True:
            for i in random.permutation(len(own)).tolist():
                windows = own[i][1]
                yield windows[random.integers(len(windows))]

    toxic, other, likely = any_window(bad), any_window(good), None
    for turn in range(rounds * steps):
        if turn and turn % steps == 0:
            scores, top, at = window_scores(network, bad), [], 0
            for _, own in bad:
                top.append((1, [own[int(scores[at : at + len(own)].argmax())]]))
                at += len(own)
            toxic = any_window(top)
            likely = window_scores(network, good)
            likely = likely / likely.sum()
        taken = [next(toxic) for _ in range(each)]
        if likely is None:
            taken += [next(other) for _ in range(each)]
        else:
            taken += [next(other) for _ in range(each - each // 2)]
            taken += [harmless[i] for i in random.choice(len(harmless), each // 2, p=likely).tolist()]
        words, at, mask = laid_out(taken)
        logits = network.logits(network.word_inputs(words), at, mask)
        grads = network.backward(((sigmoid(logits) - labels) / len(labels)).astype(np.float32), len(words))
        norm = float(np.sqrt(sum((g.astype(np.float64) ** 2).sum() for g in grads.values())))
        now = rate * min(1.0, (turn + 1) / 50) * (1 - 0.9 * turn / (rounds * steps))
        for k, g in grads.items():
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            network.params[k] -= (now * first[k] / (1 - 0.9 ** (turn + 1)) / (np.sqrt(second[k] / (1 - 0.99 ** (turn + 1))) + 1e-8)).astype(np.float32)
    return network


#: What inputs give to a layer's reset and keep gates, with the sign turned, and to its new states.
Parts = tuple[np.ndarray, np.ndarray, np.ndarray]


def parted(given: np.ndarray, size: int) -> Parts:
    """Each part in one piece, as numpy is slow on narrow slices."""
    return -given[:, :size], -given[:, size : 2 * size], given[:, 2 * size :].copy()


class Scorer:
    """The trained network, arranged for scoring: the inputs of the layers over words are computed once for each word."""

    def __init__(self, params: dict[str, np.ndarray]) -> None:
        self.network, self.params = Network(params), params

    def run(self, name: str, given: Parts, at: np.ndarray, mask: np.ndarray | None, last: bool = False) -> np.ndarray:
        """States (steps, rows, size), or the last ones, from rows of inputs that are multiplied already."""
        u = self.params[f"{name}_u"]
        size, rows = u.shape[0], at.shape[1]
        of_reset, of_keep, of_new = parted(u, size)
        held = np.zeros((rows, size), dtype=np.float32)
        out = None if last else np.empty((*at.shape, size), dtype=np.float32)
        reset, keep, new, own = (np.empty((rows, size), dtype=np.float32) for _ in range(4))
        for step in range(len(at)):
            for gate, inputs, weights in ((reset, given[0], of_reset), (keep, given[1], of_keep)):
                np.take(inputs, at[step], axis=0, out=gate, mode="clip")
                gate += np.matmul(held, weights, out=own)
                np.exp(gate, out=gate)
                gate += 1
                np.reciprocal(gate, out=gate)
            np.take(given[2], at[step], axis=0, out=new, mode="clip")
            np.matmul(held, of_new, out=own)
            own *= reset
            own += new
            np.tanh(own, out=own)
            after = held - own if out is None else np.subtract(held, own, out=out[step])
            after *= keep
            after += own
            if mask is not None:
                np.copyto(after, held, where=mask[step][:, None] <= 0)
            held = after
        return held if out is None else out

    def word_inputs(self, words: list[bytes]) -> tuple[Parts, Parts]:
        """What each word gives to the layers over words, ahead and back. Words of a length run together."""
        p, n = self.params, len(words)
        sizes = np.array([len(w) for w in words])
        rows = np.empty((n, 2 * CHAR + WORDS), dtype=np.float32)
        given = [parted(p["bytes"] @ p[f"{name}_w"] + p[f"{name}_b"], CHAR) for name in ("char_ahead", "char_back")]
        for size in np.unique(sizes).tolist():
            where = np.flatnonzero(sizes == size)
            for start in range(0, len(where), TOGETHER):
                own = where[start : start + TOGETHER]
                at = np.frombuffer(b"".join(words[i] for i in own.tolist()), dtype=np.uint8).reshape(len(own), size).T
                rows[own, :CHAR] = self.run("char_ahead", given[0], at, None, last=True)
                rows[own, CHAR : 2 * CHAR] = self.run("char_back", given[1], at[::-1], None, last=True)
        rows[:, 2 * CHAR :] = p["words"][np.fromiter((zlib.crc32(w) % TABLE for w in words), dtype=np.int64, count=n)]
        return tuple(parted(rows @ p[f"{name}_w"] + p[f"{name}_b"], STATE) for name in ("word_ahead", "word_back"))

    def window_logits(self, given: tuple[Parts, Parts], at: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        p = self.params
        ahead = self.run("word_ahead", given[0], at, mask)
        back = self.run("word_back", given[1], at[::-1], None if mask is None else mask[::-1])[::-1]
        score = np.tanh(ahead @ p["attend_w"][:STATE] + back @ p["attend_w"][STATE:] + p["attend_b"]) @ p["attend_v"]
        if mask is not None:
            score = score - 1e9 * (1 - mask)
        weight = np.exp(score - score.max(axis=0))
        value = ahead @ p["out_w"][:STATE] + back @ p["out_w"][STATE:]
        return (weight * value).sum(axis=0) / weight.sum(axis=0) + p["out_b"][0]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Of each text, the highest probability of its windows."""
        number: dict[bytes, int] = defaultdict(count().__next__)
        parts, starts, owner, base, short = [], [], [], 0, []
        for i, text in enumerate(texts):
            words = tokens(text)
            parts.append(np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words)))
            own = window_starts(len(words))
            starts += [base + x for x in own]
            owner += [i] * len(own)
            short += [len(words)] * len(own)
            base += len(words)
        out = np.zeros(len(texts))
        if not starts:
            return out
        sequence = np.concatenate([*parts, np.zeros(WINDOW, dtype=np.int64)])
        given = self.word_inputs(list(number))
        starts, owner, short = np.array(starts), np.array(owner), np.array(short)
        for few in (True, False):
            chosen = np.flatnonzero((short < WINDOW) == few)
            for begin in range(0, len(chosen), TOGETHER):
                own = chosen[begin : begin + TOGETHER]
                at = sequence[starts[own] + np.arange(WINDOW)[:, None]]
                mask = (np.arange(WINDOW)[:, None] < short[own]).astype(np.float32) if few else None
                np.maximum.at(out, owner[own], sigmoid(self.window_logits(given, at, mask).astype(np.float64)))
        return out


def sample(docs: DataFrame, labels: DataFrame, usable: Callable[[Column], Column], key: str, text: str, label: str, docs_each: int) -> list[tuple[int, list[list[bytes]]]]:
    """The bounded sample: (label, windows) of at most docs_each texts a class."""
    known = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & usable(F.col(key)))
    parts = [known.where(F.col("label") == i).groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(docs_each) for i in (0, 1)]
    chosen = parts[0].unionByName(parts[1]).groupBy("doc_id").agg(F.max("label").alias("label"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, out, own = [], [], []
            for doc, raw, mark in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ids.append(doc)
                own.append(mark)
                out.append(b" ".join(tokens(raw)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), pa.array(own, type=pa.int32()), pa.array(out, type=pa.binary())], names=["doc_id", "label", "words"])

    found = documents(docs, key, text).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label").where(F.octet_length("text") <= LEARN_BYTES)
    rows = found.mapInArrow(cut, "doc_id long, label int, words binary").collect()  # at most docs_each texts a class
    unique = {r["doc_id"]: (r["label"], bytes(r["words"]).split()) for r in rows}
    return [(label, [words[s : s + WINDOW] for s in window_starts(len(words))]) for _, (label, words) in sorted(unique.items())]


def score_toxicity(docs: DataFrame, labels: DataFrame, usable: Callable[[Column], Column], threshold: float = 0.3, key: str = "doc_id", text: str = "text", label: str = "toxic", docs_each: int = DOCS_EACH) -> DataFrame:
    """(doc_id, score, predicted) of each row. usable: of an identifier, whether its label may be learned from; docs_each:
    the most labelled texts of each class that are learned from."""
    ship(docs.sparkSession)
    network = train(sample(docs, labels, usable, key, text, label, docs_each))
    held = docs.sparkSession.sparkContext.broadcast(npy(**network.params) if network else b"")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(from_npy(held.value)) if held.value else None
        for batch in slices(batches):
            found = scorer.scores(batch.column(1).cast(pa.binary()).to_pylist()) if scorer else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array((found >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return documents(docs, key, text).mapInArrow(run, "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, usable: Callable[[Column], Column], threshold: float = 0.3, key: str = "doc_id", text: str = "text", label: str = "toxic", docs_each: int = DOCS_EACH) -> DataFrame:
    """The rows of docs that score below the threshold, all columns."""
    ship(docs.sparkSession)
    network = train(sample(docs, labels, usable, key, text, label, docs_each))
    if network is None:
        return docs
    held = docs.sparkSession.sparkContext.broadcast(npy(**network.params))

    def make() -> Callable[[list[bytes]], np.ndarray]:
        scorer = Scorer(from_npy(held.value))
        return lambda texts: scorer.scores(texts) < threshold

    return keep_rows(docs, text, make)
