"""The Merkle manifest against a plain one."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from glimmer.llm.merkle import Partials, depth, folded, levels, manifest, parent_digest

FIELDS = ("doc_id", "lang", "text")
SCHEMA = "doc_id long, lang string, text string, leaf int, proof string, place int, grp int, digest string"


def digest(row):
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row]
    return hashlib.sha256("".join(parts).encode()).digest()


def grown(leaves, arity):
    """All levels, from the leaves up."""
    found = [leaves]
    while len(found[-1]) > 1:
        last = found[-1]
        found.append([hashlib.sha256("".join(x.hex() for x in last[i : i + arity]).encode()).digest() for i in range(0, len(last), arity)])
    return found


def siblings(tree, at, arity):
    found = []
    for level in tree[:-1]:
        run = range(at // arity * arity, min(len(level), at // arity * arity + arity))
        found += [level[i] for i in run if i != at]
        at //= arity
    return found


def plain(rows, arity):
    """(doc_id, lang, leaf, subroot, root, other digests of the proof), sorted."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0] is None, row[0] or 0, digest(row[:3])))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: grown([x[2] for x in sorted(groups[g])], arity) for g in names}
    top = grown([trees[g][-1][0] for g in names], arity)
    out = []
    for n, g in enumerate(names):
        for at, (missing, doc, leaf) in enumerate(sorted(groups[g])):
            way = siblings(trees[g], at, arity) + siblings(top, n, arity)
            out.append((None if missing else doc, g, leaf, trees[g][-1][0], top[-1][0], b"".join(way)))
    return sorted(out, key=str)


def some_rows(n, seed=1):
    rng = random.Random(seed)
    rows = [(rng.randrange(10 * n), rng.choice(["de", "en", "en", "en", "fr", "é", "", None]), rng.choice([None, "", "x" * 50, str(rng.random())]), 1, "p", 2, 3, "d") for _ in range(n)]
    return rows + [rows[0]] * 9 + [(None, "en", "nothing known", 1, None, 2, 3, None), (None, None, None, None, None, None, None, None), (7, "one of its kind", "a", 1, "", 2, 3, "")]


@pytest.mark.parametrize("arity, stride, n", [(2, 10, 100), (2, 2, 150), (3, 2, 120), (5, 1, 40)])
def test_manifest_equals_plain(spark, arity, stride, n):
    rows = some_rows(n)
    found = manifest(spark.createDataFrame(rows, SCHEMA).repartition(5), FIELDS, arity=arity, stride=stride).collect()
    got = sorted(((r.doc_id, r.lang, bytes(r.leaf), bytes(r.subroot), bytes(r.root), b"".join(x for _, others in levels(bytes(r.proof)) for x in others)) for r in found), key=str)
    assert got == plain(rows, arity)


def test_proofs_tell_changed_rows(spark):
    docs = spark.createDataFrame(some_rows(60), SCHEMA)
    changed = F.when(F.col("doc_id") % 2 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text"))
    found = folded(manifest(docs, FIELDS, other=[F.col("doc_id"), F.col("lang"), changed]), "other").collect()
    assert len({bytes(r.root) for r in found}) == 1
    for r in found:
        assert (bytes(r.folded_root) == bytes(r.root)) == (r.doc_id is None or r.doc_id % 2 != 0)
        assert bytes(r.proof_sha256) == hashlib.sha256("".join(x.hex() for _, others in levels(bytes(r.proof)) for x in others).encode()).digest()


def test_one_row_and_none(spark):
    docs = spark.createDataFrame([(1, None, "a", 0, "", 0, 0, "")], SCHEMA)
    (row,) = folded(manifest(docs, FIELDS), "leaf").collect()
    assert bytes(row.leaf) == bytes(row.subroot) == bytes(row.root) == bytes(row.folded_root) == digest((1, None, "a")) and not row.proof
    assert bytes(row.proof_sha256) == hashlib.sha256(b"").digest()
    assert manifest(docs.where("doc_id < 0"), FIELDS).collect() == []
    with pytest.raises(ValueError):
        manifest(docs, FIELDS, arity=1)


def test_partial_parents_wait_for_what_is_due():
    partials, leaves = Partials(2), [bytes([i]) * 32 for i in range(5)]
    assert list(partials.add("g", 5, 0, 3, leaves[3])) == []
    assert list(partials.add("g", 5, 0, 2, leaves[2])) == [(1, 1, parent_digest(leaves[2:4]))]
    one = parent_digest(leaves[4:])
    assert list(partials.add("g", 5, 0, 4, leaves[4])) == [(1, 2, one), (2, 1, parent_digest([one]))]  # the last runs hold one child
    assert {(level, at) for _, _, level, at, _ in partials.frontier()} == {(1, 1), (2, 1)}
    list(partials.add("g", 5, 0, 0, leaves[0]))
    made = list(partials.add("g", 5, 0, 1, leaves[1]))
    assert made[-1][0] == depth(5, 2) == 3 and not list(partials.frontier())
