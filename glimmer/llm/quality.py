"""Quality rules as a short-circuit cascade.

Each rule rejects a text by measures taken from it; a text is kept if no rule rejects it. The verdict does not depend on
the order of the rules, the cost does. A sample of the whole table is measured first: of each rule the time that it adds
to what is known of a text anyway, and the share that it rejects. All texts then run through the rules by rejections per
second and stop at the first that rejects. Measures that the caller asks for are taken of each text and known to all
rules; a measure that only rules use is taken when a rule first asks for it. A text that the base condition fails runs
through no rule and is not kept.

Null or empty texts have no words. Ties in the order go to the rule that is listed first.
"""

from __future__ import annotations

import time
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.llm.common import documents, ship, slices, text_bytes, to_batch

#: What separates words.
SPACE = " \t\n\r\x0b\x0c"
#: What counts as a symbol.
SYMBOLS = "#*$%&|<>"
#: What begins an item of a list, and what ends a line that is cut off.
BULLETS, CUT = ("-", "*", "\u2022"), ("...", "\u2026")
#: Bytes of the texts in the sample, about.
SAMPLE_BYTES = 16 << 20


class Measured:
    """A text whose measures are taken when first asked for."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.known: dict[str, int] = {}

    def __getattr__(self, name: str) -> int:
        take = MEASURES.get(name)
        if take is None:
            raise AttributeError(name)
        found = self.known.get(name)
        if found is None:
            found = self.known[name] = take(self)
        return found

    @property
    def words(self) -> list[bytes]:
        found = self.__dict__.get("_words")
        if found is None:
            found = self.__dict__["_words"] = self.text.encode("utf-8", "replace").split()
        return found


def word_chars(x: Measured) -> int:
    return len(x.text) - sum(map(x.text.count, SPACE))


def symbols(x: Measured) -> int:
    return sum(map(x.text.count, SYMBOLS))


def lines_with_words(x: Measured) -> int:
    return sum(1 for line in x.text.split("\n") if line.strip(SPACE))


def dup_lines(x: Measured) -> int:
    """Lines with a word that equal an earlier line."""
    found = [line for line in x.text.split("\n") if line.strip(SPACE)]
    return len(found) - len(set(found))


def numbered(x: Measured) -> tuple[np.ndarray, int]:
    """The words as numbers, and how many are distinct."""
    found = x.__dict__.get("_numbered")
    if found is None:
        number: dict[bytes, int] = defaultdict(count().__next__)
        at = np.fromiter(map(number.__getitem__, x.words), dtype=np.int64, count=len(x.words))
        found = x.__dict__["_numbered"] = (at, len(number))
    return found


def repeat_words(x: Measured) -> int:
    """Words in three-word windows that occur at least twice, the first occurrence included."""
    n = len(x.words) - 2
    if n < 2:
        return 0
    at, size = numbered(x)
    _, pair = np.unique(at[:-1] * size + at[1:], return_inverse=True)
    _, window, times = np.unique(pair[:-1] * size + at[2:], return_inverse=True, return_counts=True)
    again = times[window] > 1
    covered = np.zeros(n + 2, dtype=bool)
    for shift in range(3):
        covered[shift : shift + n] |= again
    return int(covered.sum())


def common_words(x: Measured) -> int:
    """How often the most frequent word occurs."""
    return int(np.bincount(numbered(x)[0]).max()) if x.words else 0


def lines_that(x: Measured, holds: Callable[[str], bool]) -> int:
    return sum(1 for line in x.text.split("\n") if holds(line.strip(SPACE)))


def worded(x: Measured) -> int:
    """Words with a letter in them; anything beyond ASCII counts as one."""
    return sum(1 for w in x.words if w.lower() != w.upper() or not w.isascii())


MEASURES: dict[str, Callable[[Measured], int]] = {
    "n_words": lambda x: len(x.words),
    "word_chars": word_chars,
    "n_symbols": symbols,
    "n_lines": lines_with_words,
    "n_dup_lines": dup_lines,
    "n_repeat_words": repeat_words,
    "n_worded": worded,
    "n_common": common_words,
    "n_bullets": lambda x: lines_that(x, lambda line: line.startswith(BULLETS)),
    "n_cut": lambda x: lines_that(x, lambda line: line.endswith(CUT)),
}


@dataclass(frozen=True)
class Rule:
    """name: of the rule; rejects: whether it rejects a measured text."""

    name: str
    rejects: Callable[[Measured], bool]


def default_rules(
    most_symbols: float = 0.1, most_dup_lines: float = 0.5, mean_word: tuple[float, float] = (2.0, 15.0), least_worded: float = 0.7, most_common: float = 0.3, most_bullets: float = 0.9, most_cut: float = 0.3
) -> list[Rule]:
    """More repeated lines, items of lists or lines that are cut off than stated, of all lines with a word; one word too
    often; fewer words with letters; more symbols a word; a mean word length outside the range."""
    return [
        Rule("dup_lines", lambda x: x.n_dup_lines > most_dup_lines * max(1, x.n_lines)),
        Rule("letters", lambda x: x.n_worded < least_worded * x.n_words),
        Rule("common", lambda x: x.n_common > most_common * x.n_words),
        Rule("bullets", lambda x: x.n_bullets > most_bullets * max(1, x.n_lines)),
        Rule("cut", lambda x: x.n_cut > most_cut * max(1, x.n_lines)),
        Rule("symbols", lambda x: x.n_symbols > most_symbols * max(1, x.n_words)),
        Rule("word_length", lambda x: not mean_word[0] * x.n_words <= x.word_chars <= mean_word[1] * x.n_words),
    ]


def measured_texts(batch: pa.RecordBatch, measures: tuple[str, ...]) -> Iterator[Measured]:
    """The texts of a batch with the measures taken that are asked for."""
    for raw in batch.column(1).cast(pa.binary()).to_pylist():
        x = Measured(raw.decode("utf-8", "replace"))
        for m in measures:
            getattr(x, m)
        yield x


def fresh_copy(x: Measured) -> Measured:
    """The text with what is known of it, apart from what is taken later."""
    out = Measured(x.text)
    out.__dict__.update({k: v for k, v in x.__dict__.items() if k != "known"}, known=dict(x.known))
    return out


def rule_order(plain: DataFrame, rules: Callable[[], list[Rule]], measures: tuple[str, ...], fails: Callable[[Measured], bool] | None, sample_bytes: int) -> list[str]:
    """The rules' names by rejections per second, from a sample of all rows of about so many bytes: each row is taken
    with the same chance, so one more pass over the texts."""
    size = text_bytes(plain, "text")
    schema = pa.schema([("rule", pa.string()), ("seconds", pa.float64()), ("rejected", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = rules()
        seconds, rejected = [0.0] * len(own), [0] * len(own)
        for batch in slices(batches):
            for x in measured_texts(batch, measures):
                if fails is not None and fails(x):
                    continue
                for i, rule in enumerate(own):
                    alone = fresh_copy(x)  # so that a rule's cost holds what it adds, whatever the others took
                    began = time.perf_counter()
                    out = rule.rejects(alone)
                    seconds[i] += time.perf_counter() - began
                    rejected[i] += bool(out)
        yield to_batch({"rule": [r.name for r in own], "seconds": seconds, "rejected": rejected}, schema)

    drawn = plain.sample(fraction=min(1.0, sample_bytes / max(1, size)), seed=5) if size > sample_bytes else plain
    sums = drawn.mapInArrow(run, "rule string, seconds double, rejected long").groupBy("rule").agg(F.sum("seconds").alias("seconds"), F.sum("rejected").alias("rejected")).collect()  # a row a rule
    rate = {r["rule"]: (r["rejected"] + 0.5) / (r["seconds"] + 1e-9) for r in sums}
    return sorted((rule.name for rule in rules()), key=lambda name: -rate.get(name, 0.0))


def quality_cascade(
    docs: DataFrame, rules: Callable[[], list[Rule]] = default_rules, measures: tuple[str, ...] = (), fails: Callable[[Measured], bool] | None = None, sample_bytes: int = SAMPLE_BYTES, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, the measures asked for, n_rules, kept) of each row; n_rules: how many rules it ran through. rules() makes
    the rules, with names of their own, on the executors; fails: the base condition. No exchange of texts."""
    ship(docs.sparkSession)
    plain = documents(docs, key, text)
    order = rule_order(plain, rules, measures, fails, sample_bytes)
    schema = pa.schema([("doc_id", pa.int64()), *((m, pa.int64()) for m in measures), ("n_rules", pa.int64()), ("kept", pa.bool_())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_name = {rule.name: rule for rule in rules()}
        cascade = [by_name[name].rejects for name in order]
        for batch in slices(batches):
            out: dict[str, list] = {m: [] for m in [*measures, "n_rules", "kept"]}
            for x in measured_texts(batch, measures):
                for m in measures:
                    out[m].append(x.known[m])
                ran, kept = 0, fails is None or not fails(x)
                if kept:
                    for rejects in cascade:
                        ran += 1
                        if rejects(x):
                            kept = False
                            break
                out["n_rules"].append(ran)
                out["kept"].append(kept)
            yield to_batch({"doc_id": batch.column(0), **out}, schema)

    ddl = ", ".join(["doc_id long", *(f"{m} long" for m in measures), "n_rules long", "kept boolean"])
    return plain.mapInArrow(run, ddl)
