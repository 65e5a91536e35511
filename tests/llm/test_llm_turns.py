"""Repair of conversations against a plain search over all edits."""

import hashlib
import random
import re

import pytest

from glimmer.llm.turns import audits, damaged, repaired, transcripts

SCHEMA = "conv_id long, turn long, role string, text string, conv int, edit string, place int, audit string"


def plain(rows):
    """rows: (turn, role, text) of one conversation in order. (blank, duplicate, truncated, cost, audit, lines): the least
    (cost, audit) of all paths, with up to three inserts in a row."""
    seen, kinds = set(), []
    for _, role, text in rows:
        end = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        kinds.append("b" if not end else "d" if (role, text) in seen else "t" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    follows = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    def insert(paths):
        for _ in range(3):
            for state, (cost, audit, lines) in list(paths.items()):
                for role in ("user", "assistant"):
                    if (to := follows.get((state, role[0]))) is not None:
                        better = (cost + 5, audit + "I", [*lines, f"{role}:"])
                        if to not in paths or better < paths[to]:
                            paths[to] = better
        return paths

    paths = {"": (0, "", [])}
    for (_, role, text), kind in zip(rows, kinds, strict=True):
        after = {}

        def take(state, path, after=after):
            if state not in after or path < after[state]:
                after[state] = path

        for state, (cost, audit, lines) in insert(paths).items():
            take(state, (cost + 2, audit + "D", lines))
            if kind in ("b", "d"):
                continue
            extra = 5 if kind == "t" else 0
            if (to := follows.get((state, role[:1]))) is not None:
                take(to, (cost + extra, audit + "K", [*lines, f"{role}:{text}"]))
            for new in ("user", "assistant"):
                if (to := follows.get((state, new[0]))) is not None:
                    take(to, (cost + extra + 1, audit + "R", [*lines, f"{new}:{text}"]))
        paths = after
    cost, audit, lines = min(v for k, v in insert(paths).items() if k in ("", "a"))
    return kinds.count("b"), kinds.count("d"), kinds.count("t"), cost, audit, lines


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def expected(rows):
    groups = {}
    for conv, turn, role, text, *_ in rows:
        groups.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), digest(r[1], r[2])))
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [r[1][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        *found, lines = plain(own)
        out[conv] = (gaps, illegal, *found, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def results(turns, **more):
    found = audits(turns, **more)
    told = {r.conv: r for r in transcripts(repaired(turns, found)).collect()}
    return {r.conv: (told[r.conv].gaps, told[r.conv].illegal, r.blank, r.duplicate, r.truncated, r.cost, r.audit, told[r.conv].repaired_sha256) for r in found.collect() if r.conv in told}


def some_rows(seed=3):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "so it goes", "", " \t\n", None, "Why?  ", "é…", "End.\x0b", "."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "s", "Uwe"]
    rows = []
    for conv in [*range(60), None, -5]:
        for turn in range(rng.randrange(1, 14) if conv != 7 else 150):
            rows.append((conv, rng.choice([turn, turn, turn, turn, 2 * turn, None, 3]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"{rng.random()}.", 1, "e", 2, "a"))
    rows += [(100, 5, "user", "the same.", 1, "", 2, "")] * 40 + [(101, t, "system", f"{t}.", 1, "", 2, "") for t in range(30)]
    return rows + [(102, t, "user" if t % 2 else "assistant", f"{t}.", 1, "", 2, "") for t in range(200)]


@pytest.mark.parametrize("segment", [64, 3])
def test_repair_equals_plain_search(spark, segment):
    rows = some_rows()
    turns = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert results(turns, segment=segment) == expected(rows)


def test_repaired_rows_match_the_grammar(spark):
    turns = spark.createDataFrame(some_rows(5), SCHEMA)
    found = audits(turns)
    by = {}
    for r in repaired(turns, found).collect():
        by.setdefault(r.conv, []).append(r)
    for r in found.collect():
        own = by[r.conv]
        assert "".join(x.edit for x in own) == r.audit
        assert re.fullmatch("(s?(ua)+)?", "".join(x.role[:1] for x in own if x.edit != "D"))
        assert all(x.turn is None and x.was is None and x.text == "" for x in own if x.edit == "I")


def test_conversations_without_rows(spark):
    turns = spark.createDataFrame(some_rows(), SCHEMA)
    every = spark.createDataFrame([(1,), (500,), (None,), (500,)], "conv_id long")
    found = {r.conv: r for r in audits(turns, every=every).collect()}
    assert len(found) == 66 and found[500].audit == "" and found[500].cost == found[500].blank == found[500].duplicate == found[500].truncated == 0
    assert audits(turns.where("false")).collect() == [] and repaired(turns.where("false"), audits(turns.where("false"))).collect() == []


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", f"What? {c}, {t}.") for c in [1, 2, None] for t in [*range(40), None]]
    text = lambda c, t: f"{' ' if c is None else c}:{' ' if t is None else t}"
    want = []
    for c, t, role, said in rows:
        fault = zlib.crc32(text(c, t).encode()) % 20
        if fault:
            want += [(c, t, "user" if fault == 4 else role, "" if fault == 1 else re.sub("[.!?]", "", said) if fault == 2 else said)] * (2 if fault == 3 else 1)
    got = [tuple(r) for r in damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) != len(rows)
