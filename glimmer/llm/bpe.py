"""Byte-level BPE encoding and decoding.

Encoding. The merges are compiled, as text calls for it, into a deterministic transducer over bytes. It rests on two
facts about byte-pair encoding: the encoding of a prefix followed by more text is again composed of neighbours that
would stay apart if encoded alone, and for each prefix exactly one token can stand last. A state therefore holds, for
every place at which a token now being read may have begun, the trie node reached and the token before it; its output is
the one token that ends here. States do not hold what is still to be emitted, so the rank table bounds their number.
They and their transitions are made on first use; when there are as many as memory allows all are forgotten and made
anew, and every match goes through them.

Emission. All places at which a token may have begun are reached from one common place by the tokens that end there; the
tokens up to it are certain. It lies back by the longest token at most a few times, so the lookahead is bounded; long
matches are emitted as they are read.

Decoding. Token bytes go through an incremental UTF-8 machine, which turns chunks into text and keeps what is incomplete
for the next chunk; its text is the result. Broken sequences, which no encoded text gives, become U+FFFD.

Null or empty texts give no tokens. The time for a match is in proportion to its length.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from glimmer.llm.common import documents, ship, slices, to_batch

#: The largest rank file that is broadcast.
MOST_RANK_BYTES = 64 << 20
#: Bounds of what a worker remembers: states, matches and token pairs.
MOST_STATES, MOST_MATCHES, MOST_PAIRS = 250_000, 300_000, 500_000
#: Subtrees of so many tokens at most are searched for one that can follow.
FEW_BELOW = 24
#: Longer matches are not remembered.
LONGEST_MATCH = 32
#: Places of a match whose tokens wait to be emitted.
MOST_WAITING = 4096
#: Tokens that are decoded together.
CHUNK = 1 << 12


def parse_ranks(content: bytes) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


def splitting_pattern(pattern: str) -> str:
    """The pattern with white space as Unicode defines it, which leaves out U+001C to U+001F."""
    return pattern.replace(r"[^\s\p{L}", r"[^\p{White_Space}\p{L}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


class Node:
    """A trie node: its depth, the token that ends here, the next bytes, and the tokens below it if they are few."""

    __slots__ = ("below", "depth", "next", "token")

    def __init__(self, depth: int) -> None:
        self.next: dict[int, Node] = {}
        self.depth = depth
        self.token: int | None = None
        self.below: tuple[int, ...] | None = ()


class State(dict):
    """The next state for each byte, made on first use. items: (trie node, token before it) of each place at which a
    token may have begun, oldest first; the last one is the place reached. token: the output, the token that ends here."""

    __slots__ = ("items_at", "machine", "token")

    def __init__(self, machine: Transducer, items: tuple) -> None:
        self.machine, self.items_at, self.token = machine, items, items[-1][1]

    def __missing__(self, byte: int) -> State:
        found = self[byte] = self.machine.step(self, byte)
        return found


class Matches(dict):
    """The ids of matches, in two generations, so that frequent ones stay known when the older generation goes."""

    __slots__ = ("encode", "older")

    def __init__(self, encode: Callable[[bytes], bytes]) -> None:
        self.encode, self.older = encode, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            found = self.encode(piece.encode("utf-8"))
        if len(piece) <= LONGEST_MATCH:
            if len(self) >= MOST_MATCHES // 2:
                self.older = dict(self)
                self.clear()
            self[piece] = found
        return found


class Transducer:
    """The encoder for one rank table; see the module's text."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.size_of = {rank: len(token) for token, rank in ranks.items()}
        self.root = Node(0)
        for token, rank in ranks.items():
            node = self.root
            for byte in token:
                following = node.next.get(byte)
                if following is None:
                    following = node.next[byte] = Node(node.depth + 1)
                node = following
            node.token = rank
        self.list_below(self.root)
        self.split: dict[int, tuple[int, int] | None] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.rows: dict[int, dict[int, bool]] = {}
        self.known = 0
        self.matches = Matches(self.encode_bytes)
        self.states: dict[tuple, State] = {}
        self.made = 0
        self.start = self.state(((self.root, -1),))

    def list_below(self, node: Node) -> tuple[int, ...] | None:
        """Sets below for the subtree; returns the tokens at or below node if they are few."""
        found: tuple[int, ...] | None = ()
        for child in node.next.values():
            tokens = self.list_below(child)
            found = None if found is None or tokens is None or len(found) + len(tokens) > FEW_BELOW else found + tokens
        node.below = found
        return None if found is None else found if node.token is None else (node.token, *found)

    def state(self, items: tuple) -> State:
        found = self.states.get(items)
        if found is None:
            if len(self.states) >= MOST_STATES:
                self.states = {}
                self.start = State(self, ((self.root, -1),))
            found = self.states[items] = State(self, items)
            self.made += 1
        return found

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        if token not in self.split:
            text = self.bytes_of[token]
            parts = [text[i : i + 1] for i in range(len(text))]
            while len(parts) > 2:
                best, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.split[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.split[token]

    def edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """What stands at the token's left (0) or right (1) end while it is being merged: the bytes, and the rank of
        the merge that ends them."""
        found = self.edges[side].get(token)
        if found is None:
            found, end, at = [], 1 << 60, token
            while True:
                found.append((self.bytes_of[at], end))
                parts = self.halves(at)
                if parts is None:
                    break
                end, at = at, parts[side]
            self.edges[side][token] = found
        return found

    def apart(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart when their bytes are encoded together: no merge across the boundary comes
        before both of its parts are merged away from it. Of equal ranks the leftmost comes first."""
        row = self.rows.get(left)
        if row is None:
            row = self.rows[left] = {}
        found = row.get(right)
        if found is None:
            self.known += 1
            if self.known >= MOST_PAIRS:
                self.rows, self.known = {left: row}, len(row)
            rank_of, starts = self.ranks.get, self.edge(right, 0)
            found = True
            for a, a_end in self.edge(left, 1):
                for b, b_end in starts:
                    rank = rank_of(a + b)
                    if rank is not None and rank < a_end and rank <= b_end:
                        found = False
                        break
                if not found:
                    break
            row[right] = found
        return found

    def alive(self, node: Node, last: int) -> bool:
        """Whether a token below node may follow last. Large subtrees are taken to hold one."""
        if last < 0 or node.below is None:
            return True
        return any(self.apart(last, token) for token in node.below)

    def step(self, state: State, byte: int) -> State:
        """The next state for a byte."""
        items, reached = [], None
        for node, last in state.items_at:
            child = node.next.get(byte)
            if child is None:
                continue
            token = child.token
            if token is not None and reached is None and (last < 0 or self.apart(last, token)):
                reached = token
            if child.next and self.alive(child, last):
                items.append((child, last))
        if reached is None:
            raise ValueError(f"the rank table has no token for byte {byte}")
        items.append((self.root, reached))
        return self.state(tuple(items))

    def certain(self, state: State, tokens: list[int]) -> int:
        """The last place that the tokens before all open places have in common. tokens: those that end at each place."""
        at = len(tokens)
        open_at = {at - node.depth for node, _ in state.items_at}
        while len(open_at) > 1:
            last = max(open_at)
            open_at.remove(last)
            open_at.add(last - self.size_of[tokens[last - 1]])
        return open_at.pop()

    def path(self, tokens: list[int], at: int) -> bytes:
        """The ids up to a place, given the token that ends at each place."""
        out, size_of = [], self.size_of
        while at:
            token = tokens[at - 1]
            out.append(token)
            at -= size_of[token]
        out.reverse()
        return struct.pack(f"<{len(out)}I", *out)

    def encode_bytes(self, text: bytes) -> bytes:
        """The ids of one match, as little-endian unsigned 32-bit integers."""
        state, tokens, out = self.start, [], []
        for begin in range(0, len(text), MOST_WAITING):
            for byte in text[begin : begin + MOST_WAITING]:
                state = state[byte]
                tokens.append(state.token)
            if begin + MOST_WAITING < len(text):
                at = self.certain(state, tokens)
                out.append(self.path(tokens, at))
                del tokens[:at]
        out.append(self.path(tokens, len(tokens)))
        return b"".join(out)

    def encode(self, text: str, split: Callable[[str], list[str]]) -> bytes:
        """The ids of a text that split cuts into matches."""
        return b"".join(map(self.matches.__getitem__, split(text)))


class Utf8Machine:
    """Turns chunks of bytes into text; at most three bytes of an unfinished character wait for the next chunk. Broken
    sequences become U+FFFD."""

    def __init__(self) -> None:
        self.waiting = b""
        self.valid = True

    @staticmethod
    def unfinished(chunk: bytes) -> int:
        """How many bytes at the end of chunk begin a character that may still be completed."""
        for back in range(1, min(3, len(chunk)) + 1):
            byte = chunk[-back]
            if byte < 0x80:
                return 0
            if byte >= 0xC0:
                need = 2 if 0xC2 <= byte < 0xE0 else 3 if 0xE0 <= byte < 0xF0 else 4 if 0xF0 <= byte < 0xF5 else 0
                if need <= back:
                    return 0
                if back > 1:  # the second byte's range depends on the first
                    second = chunk[-back + 1]
                    low = {0xE0: 0xA0, 0xF0: 0x90}.get(byte, 0x80)
                    high = {0xED: 0x9F, 0xF4: 0x8F}.get(byte, 0xBF)
                    if not low <= second <= high:
                        return 0
                return back
        return 0

    def feed(self, chunk: bytes) -> str:
        data = self.waiting + chunk
        keep = self.unfinished(data)
        self.waiting = data[len(data) - keep :]
        return self.text(data[: len(data) - keep])

    def finish(self) -> str:
        """The rest; what is still unfinished is broken."""
        data, self.waiting = self.waiting, b""
        return self.text(data)

    def text(self, data: bytes) -> str:
        try:
            return data.decode("utf-8")
        except UnicodeDecodeError:
            self.valid = False
            return data.decode("utf-8", "replace")


_TRANSDUCERS: dict[bytes, Transducer] = {}
_TOKENS: dict[bytes, dict[int, bytes]] = {}
DECODED = "doc_id long, n_tokens long, ids binary, decoded string, whole boolean"


def transducer(content: bytes) -> Transducer:
    """The worker's transducer for a rank file; it outlives a task."""
    key = hashlib.sha256(content).digest()
    if key not in _TRANSDUCERS:
        _TRANSDUCERS.clear()
        _TRANSDUCERS[key] = Transducer(parse_ranks(content))
    return _TRANSDUCERS[key]


def token_bytes(content: bytes) -> dict[int, bytes]:
    """The bytes of each token, as decoding needs them; kept by the worker."""
    key = hashlib.sha256(content).digest()
    if key not in _TOKENS:
        _TOKENS.clear()
        _TOKENS[key] = {rank: token for token, rank in parse_ranks(content).items()}
    return _TOKENS[key]


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as file:
        content = file.read(MOST_RANK_BYTES + 1)
    if len(content) > MOST_RANK_BYTES:
        raise ValueError(f"{path} is larger than {MOST_RANK_BYTES} bytes")
    return content


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", decode: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids) of each row: ids are little-endian unsigned 32-bit integers. One pass over the texts, no
    exchange; the rank file, of checked size, is the only thing broadcast. With decode, also what bpe_decode makes of
    the ids, by the same worker: (decoded, whole)."""
    spark = docs.sparkSession
    ship(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))
    source = splitting_pattern(pattern)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), *([("decoded", pa.string()), ("whole", pa.bool_())] if decode else [])])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        from glimmer.llm.bpe import decoded as bytes_in
        from glimmer.llm.bpe import transducer as of

        machine, split = of(ranks.value), regex.compile(source).findall
        for batch in slices(batches):
            ids = [machine.encode(x.decode("utf-8", "replace"), split) for x in batch.column(1).cast(pa.binary()).to_pylist()]
            out = {"doc_id": batch.column(0), "n_tokens": [len(x) // 4 for x in ids], "ids": ids}
            if decode:
                found = [bytes_in(x, machine.bytes_of) for x in ids]
                out |= {"decoded": [x for x, _ in found], "whole": [x for _, x in found]}
            yield to_batch(out, schema)

    return documents(docs, key, text).mapInArrow(run, DECODED if decode else "doc_id long, n_tokens long, ids binary")


def decoded(ids: bytes, bytes_of: dict[int, bytes]) -> tuple[str, bool]:
    """What the UTF-8 machine makes of ids, chunk by chunk; and whether no sequence was broken."""
    machine, out = Utf8Machine(), []
    for start in range(0, len(ids), 4 * CHUNK):
        part = ids[start : start + 4 * CHUNK]
        out.append(machine.feed(b"".join(map(bytes_of.__getitem__, struct.unpack(f"<{len(part) // 4}I", part)))))
    out.append(machine.finish())
    return "".join(out), machine.valid


def decode_stream(chunks: Iterable[bytes], bytes_of: dict[int, bytes]) -> Iterator[str]:
    """The text of a stream of id chunks, each piece as soon as it is certain."""
    machine = Utf8Machine()
    for chunk in chunks:
        yield machine.feed(b"".join(map(bytes_of.__getitem__, struct.unpack(f"<{len(chunk) // 4}I", chunk))))
    yield machine.finish()


def bpe_decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded, whole) from what bpe_encode returns: decoded is the text, whole says whether the
    bytes were valid UTF-8."""
    spark: SparkSession = encoded.sparkSession
    ship(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string()), ("whole", pa.bool_())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from glimmer.llm.bpe import decoded as bytes_in
        from glimmer.llm.bpe import token_bytes as of

        bytes_of = of(ranks.value)
        for batch in batches:
            each = max(1, int(batch.num_rows * (4 << 20) // max(1, batch.nbytes)))
            for start in range(0, batch.num_rows, each):
                part = batch.slice(start, each)
                found = [bytes_in(x, bytes_of) for x in part.column(2).to_pylist()]
                yield to_batch({"doc_id": part.column(0), "n_tokens": part.column(1), "ids": part.column(2), "decoded": [x for x, _ in found], "whole": [x for _, x in found]}, schema)

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, DECODED)
