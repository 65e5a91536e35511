"""Repair of the structure of conversations by their cheapest edits.

A conversation's rows stand in order of turn (null first), then role, then the SHA-256 of role and text; rows equal in all
of these are alike. Roles are read by their initials, which a repair makes match (s?(ua)+)?. Edits: Keep (0), Rerole to
user or assistant (1), Delete (2; blank rows and rows that repeat an earlier one must go), Insert a user or assistant turn
without text (5); a truncated row that stays costs 5 more. Among the cheapest lists of edits the ASCII-least wins.

The search is a shortest path over four grammar states (start, after system, after user, after assistant). A DuckDB
recursive query runs inside each hash-partitioned batch: each recursion advances one row for all conversations of the
batch and keeps, for each grammar state, the least cost and its audit. A long conversation is no single group: it is cut
into segments of SEGMENT places, each solved from every state it may start in; segments then are the steps of longer
segments, by the same query, until one is left. Rows that repeat an earlier one never reach the search: the first of each
(role, text) is found by an aggregation, and the gaps that the others leave are deletions.

Two inserts in a row are never cheapest (without them the rest still matches; a kept system row before them is cheaper
deleted), and equally cheap lists up to a row are never prefixes of each other, as the longer one holds more inserts, so
keeping the least of each state is enough.

The repaired rows follow from one pass over the rows in order beside the audit. That pass, and the audit itself, are the
only things that one task does for a whole conversation, row by row and in bounded memory but for the audit. Null roles and
texts are one space. A null conversation is one of its own. Empty conversations have an empty audit.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glimmer.llm.common import arrow_schema, placed, quoted, ship, slices, stage, to_batch, trim

#: Places of a conversation that make up a segment.
SEGMENT = 64
#: Steps that a batch of whole segments holds before it is solved, and bytes of their audits.
BATCH_STEPS, BATCH_BYTES = 8192, 8 << 20
#: What counts as white space.
SPACE = " \t\n\x0b\x0c\r"

STEP = "conv long, lo long, hi long, kind int, frm int, nxt int, cost long, letters string"

#: Grammar states: 0 start, 1 after system, 2 after user, 3 after assistant. says: which state a turn leads to.
MOVES = """
CREATE TEMP TABLE moves AS
WITH says(initial, frm, nxt) AS (VALUES (0, 0, 1), (1, 0, 2), (1, 1, 2), (1, 3, 2), (2, 2, 3)),
kinds AS (SELECT range::INT AS kind, range % 4 AS initial, range // 4 % 2 = 1 AS blank, 5 * (range // 8) AS cut FROM range(16)),
spoken AS (SELECT frm, nxt FROM says WHERE initial > 0),
stays AS (
  SELECT kind, frm, nxt, cut AS cost, 'K' AS letters FROM kinds JOIN says USING (initial) WHERE NOT blank
  UNION ALL SELECT kind, frm, nxt, cut + 1, 'R' FROM kinds, spoken WHERE NOT blank
)
SELECT kind, frm, nxt, cost::BIGINT AS cost, letters FROM stays
UNION ALL SELECT kind, spoken.frm, stays.nxt, cost + 5, 'I' || letters FROM stays JOIN spoken ON spoken.nxt = stays.frm
UNION ALL SELECT kind, range::INT, range::INT, 2, 'D' FROM kinds, range(4)
"""

#: Steps of segments (seg), numbered in order (k); a single row's moves follow from its kind.
STEPS = """
CREATE OR REPLACE TEMP TABLE steps AS
SELECT seg, conv, dense_rank() OVER (PARTITION BY seg ORDER BY lo) AS k, lo, hi, coalesce(m.frm, s.frm) AS frm, coalesce(m.nxt, s.nxt) AS nxt,
  coalesce(m.cost, s.cost) AS cost, coalesce(m.letters, s.letters) AS letters
FROM given s LEFT JOIN moves m ON s.kind = m.kind
"""

#: Each recursion takes the next step of every segment and keeps the least (cost, audit) of each state that it ends in.
SOLVE = """
WITH RECURSIVE best AS (
  SELECT seg, q AS start, 0::BIGINT AS k, first AS pos, q, 0::BIGINT AS cost, '' AS audit FROM (SELECT seg, min(lo) AS first FROM steps GROUP BY seg), (SELECT unnest($starts)::INT AS q)
  UNION ALL
  SELECT seg, start, k, hi, nxt, least.cost, least.audit FROM (
    SELECT b.seg, b.start, s.k, s.hi, s.nxt, min({'cost': b.cost + 2 * (s.lo - b.pos) + s.cost, 'audit': b.audit || repeat('D', s.lo - b.pos) || s.letters}) AS least
    FROM best b JOIN steps s ON s.seg = b.seg AND s.k = b.k + 1 AND s.frm = b.q GROUP BY b.seg, b.start, s.k, s.hi, s.nxt)
)
SELECT e.conv, e.first AS lo, b.pos AS hi, NULL::INT AS kind, b.start AS frm, b.q AS nxt, b.cost, b.audit AS letters
FROM best b JOIN (SELECT seg, any_value(conv) AS conv, min(lo) AS first, max(k) AS n FROM steps GROUP BY seg) e ON e.seg = b.seg AND e.n = b.k
"""


def solved(steps: DataFrame, places: int | None, starts: list[int]) -> DataFrame:
    """Steps (STEP) of each segment of so many places (None: of each conversation) as one step from each of the starts to
    each state that it can end in."""
    schema = arrow_schema(STEP)
    segment = F.lit(0).cast("long") if places is None else F.floor(F.col("lo") / places)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        db = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
        db.execute(MOVES)

        def answer(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            given = pa.table([*(pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=False)), pa.array(columns[-1], type=pa.int64())], names=[*schema.names, "seg"])
            db.register("given", given)
            db.execute(STEPS)
            found = db.execute(SOLVE, {"starts": starts}).fetchall()
            db.unregister("given")
            return to_batch(dict(zip(schema.names, map(list, zip(*found, strict=True)), strict=True)) if found else {n: [] for n in schema.names}, schema)

        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        held, number, size = [], 0, 0
        for _, group in groupby(rows, key=lambda r: (r[0], r[-1])):
            own = [(*r[:-1], number) for r in group]  # SEGMENT steps of a few moves at most
            held += own
            number, size = number + 1, size + sum(len(r[7] or "") for r in own)
            if len(held) >= BATCH_STEPS or size >= BATCH_BYTES:
                yield answer(held)
                held, number, size = [], 0, 0
        if held:
            yield answer(held)
        db.close()
        trim()

    names = [x.split()[0] for x in STEP.split(", ")]
    dealt = steps.withColumn("seg", segment).repartition("conv", "seg").sortWithinPartitions("conv", "seg", "lo").select(*names, "seg")
    return dealt.mapInArrow(run, STEP)


def plain_rows(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text) without null roles and texts, and the digest that tells rows of a turn and role apart."""
    own = F.coalesce(F.col(quoted(role)).cast("string"), F.lit(" "))
    said = F.coalesce(F.col(quoted(text)).cast("string"), F.lit(" "))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(own).cast("string"), F.lit(":"), own, said).cast("binary"), 256))
    return turns.select(F.col(quoted(conv)).cast("long").alias("conv"), F.col(quoted(turn)).cast("long").alias("turn"), own.alias("role"), said.alias("text"), digest.alias("digest"))


def damaged(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) of turns with planted faults, by crc32("conv_id:turn") % 20: 0 drops the row, 1 empties
    its text, 2 takes out full stops, exclamation and question marks, 3 repeats it, 4 makes its role user. Nulls: a space."""
    named = F.concat(*(F.coalesce(F.col(quoted(c)).cast("string"), F.lit(" ")) if c else F.lit(":") for c in (conv, None, turn)))
    own, said = (F.coalesce(F.col(quoted(c)).cast("string"), F.lit(" ")) for c in (role, text))
    rows = turns.select(F.col(quoted(conv)).cast("long").alias("conv_id"), F.col(quoted(turn)).cast("long").alias("turn"), own.alias("role"), said.alias("text"), (F.crc32(named.cast("binary")) % 20).alias("fault")).where("fault <> 0")
    fault, copies = F.col("fault"), F.when(F.col("fault") == 3, 2).otherwise(1)
    changed = F.when(fault == 1, "").when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("copy")).drop("copy")


def audits(turns: DataFrame, every: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """(conv, blank, duplicate, truncated, cost longs, audit string) of each conversation of turns, and of `every` (column
    conv), which may hold more."""
    ship(turns.sparkSession)
    end = F.rtrim("text", F.lit(SPACE))
    blank, cut = end == "", ~F.substring(end, -1, 1).isin(".", "!", "?")
    initial = F.substring("role", 1, 1)
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    rows = plain_rows(turns, conv, turn, role, text).select("conv", "turn", "role", "digest", (number + F.when(blank, 4).otherwise(0) + F.when(~blank & cut, 8).otherwise(0)).cast("int").alias("kind"))
    rows = placed(rows, [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")])
    firsts = stage(rows.groupBy("conv", "digest").agg(F.min(F.struct("place", "kind")).alias("r")).select("conv", F.col("r.place").alias("lo"), F.col("r.kind").alias("kind")), "turn-firsts")
    is_blank, is_cut = F.col("kind").bitwiseAND(4) > 0, F.col("kind").bitwiseAND(8) > 0
    counts = stage(rows.groupBy("conv").agg(F.count("*").alias("n"), F.min("place").alias("start"), F.count_if(is_blank).alias("blank")), "turn-counts")
    most = counts.agg(F.max("n")).first()[0] or 0

    none = {c: F.lit(None).cast(t) for c, t in (("frm", "int"), ("nxt", "int"), ("cost", "long"), ("letters", "string"))}
    steps = firsts.withColumn("hi", F.col("lo") + 1).withColumns(none)
    places = segment
    while places < most:
        steps = stage(solved(steps, places, [0, 1, 2, 3]), "turn-steps")
        places *= segment
    ends = solved(steps, None, [0])

    told = counts.select("conv", "n", "start", "blank")
    unique = firsts.groupBy("conv").agg(F.count_if(~is_blank).alias("unique"), F.count_if(is_cut).alias("truncated"))
    best = ends.select("conv", F.struct("nxt", "cost", "letters", "hi").alias("end"))
    all_of = told if every is None else told.unionByName(every.select(F.col(quoted(conv)).cast("long").alias("conv")).distinct(), allowMissingColumns=True)
    met = all_of.unionByName(unique, allowMissingColumns=True).unionByName(best, allowMissingColumns=True)
    one = met.groupBy("conv").agg(*(F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("n", "start", "blank", "unique", "truncated")), F.collect_list("end").alias("ends"))  # four ends at most

    def closed(e: Column) -> Column:
        rest = F.col("start") + F.col("n") - e["hi"]
        # a conversation may end at the start, after an assistant, or after a user whose answer is inserted
        return F.struct((e["cost"] + 2 * rest + F.when(e["nxt"] == 2, 5).otherwise(0)).alias("cost"), F.concat(e["letters"], F.repeat(F.lit("D"), rest.cast("int")), F.when(e["nxt"] == 2, "I").otherwise("")).alias("audit"))

    least = F.array_min(F.transform(F.filter("ends", lambda e: e["nxt"] != 1), closed))
    return one.withColumn("least", least).select(
        "conv", "blank", (F.col("n") - F.col("blank") - F.col("unique")).alias("duplicate"), "truncated", F.coalesce("least.cost", F.lit(0)).alias("cost"), F.coalesce("least.audit", F.lit("")).alias("audit")
    )


EDITED = "conv long, edit string, turn long, was string, role string, text string"


def repaired(turns: DataFrame, found: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, edit, turn, was, role, text): the rows of each conversation in order with their edits, was: the role before.
    Deleted rows keep role and text; inserted ones have no turn and no `was`. A conversation's rows are consecutive in one
    partition. found: what audits() returned."""
    schema = arrow_schema(EDITED)
    rows = plain_rows(turns, conv, turn, role, text).withColumns({"kind": F.lit(1), "audit": F.lit(None).cast("string")})
    heads = found.select("conv", F.lit(0).alias("kind"), "audit")
    both = rows.unionByName(heads, allowMissingColumns=True).select("conv", "kind", "turn", "role", "text", "digest", "audit")
    dealt = both.repartition("conv").sortWithinPartitions("conv", "kind", F.col("turn").asc_nulls_first(), "role", "digest").drop("digest")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, last, of = "", 0, "", None

        def inserted(out: list[tuple]) -> None:
            nonlocal at, last
            while audit[at : at + 1] == "I":
                said = "assistant" if last == "u" else "user"
                out.append((of, "I", None, None, said, ""))
                at, last = at + 1, said[0]

        for batch in slices(batches):
            out = []
            for conv, kind, turn, role, text, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:  # the next conversation
                    inserted(out)
                    audit, at, last, of = own, 0, "", conv
                    continue
                inserted(out)
                edit, was = audit[at], role
                at += 1
                if edit == "R":
                    role = "assistant" if last == "u" else "user"
                if edit != "D":
                    last = role[:1]
                out.append((of, edit, turn, was, role, text))
            if out:
                yield to_batch(dict(zip(schema.names, map(list, zip(*out, strict=True)), strict=True)), schema)
        rest = []
        inserted(rest)
        if rest:
            yield to_batch(dict(zip(schema.names, map(list, zip(*rest, strict=True)), strict=True)), schema)

    return dealt.mapInArrow(run, EDITED)


def transcripts(edited: DataFrame) -> DataFrame:
    """(conv, gaps, illegal longs, repaired_sha256 string) of each conversation of repaired(): turns missing between the
    least and the largest, neighbours whose initials may not follow each other before repair, and the SHA-256 of the
    remaining `role:text`, joined by newlines. Read row by row."""
    import hashlib

    schema = arrow_schema("conv long, gaps long, illegal long, repaired_sha256 string")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in slices(batches) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out = []
        for conv, group in groupby(rows, key=lambda r: r[0]):
            first, last, different, illegal, before, sha, some = None, None, 0, 0, None, hashlib.sha256(), False
            for _, edit, turn, was, role, text in group:
                if edit != "I":
                    if turn is not None and turn != last:
                        first, last, different = turn if first is None else first, turn, different + 1
                    illegal += before is not None and before + was[:1] not in ("su", "ua", "au")
                    before = was[:1]
                if edit != "D":
                    sha.update(("\n" * some + role + ":").encode())
                    sha.update(text.encode())
                    some = True
            out.append((conv, last - first + 1 - different if different else 0, illegal, sha.hexdigest()))
            if len(out) == 2000:
                yield to_batch(dict(zip(schema.names, map(list, zip(*out, strict=True)), strict=True)), schema)
                out = []
        if out:
            yield to_batch(dict(zip(schema.names, map(list, zip(*out, strict=True)), strict=True)), schema)

    return edited.mapInArrow(run, "conv long, gaps long, illegal long, repaired_sha256 string")
