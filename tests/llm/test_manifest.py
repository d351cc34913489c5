"""The Merkle manifest against a direct one with hashlib."""

import random
import zlib
from hashlib import sha256

import pytest

from gleanery.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, pos long, leaf string, steps int, extra string"


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf_of(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree_of(leaves):
    """The root, and for each leaf its steps (left, right)."""
    steps, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        runs = [nodes[i:i + 3] for i in range(0, len(nodes), 3)]
        for s, a in zip(steps, at):
            run = runs[a // 3]
            s.append(("".join(run[:a % 3]), "".join(run[a % 3 + 1:])))
        at, nodes = [a // 3 for a in at], [h("".join(run)) for run in runs]
    return nodes[0] if nodes else None, steps


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf_of(row), row))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    lower = [tree_of([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in order]
    root, upper = tree_of([r for r, _ in lower])
    out = []
    for s, (subroot, ways), more in zip(order, lower, upper):
        for (_, _, leaf, row), way in zip(sorted(groups[s], key=lambda x: x[:3]), ways):
            way = way + more
            now = leaf
            if row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                now = leaf_of((*row[:4], row[4].replace("\n", "")))
            for left, right in way:
                now = h(left + now + right)
            out.append((str(row[0]), leaf, subroot, root, h("".join(a + b for a, b in way)), now, now == root))
    return sorted(out)


def got(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 7, "y", 1, "z") for r in rows], SCHEMA).repartition(5)
    found = manifest.audit(frame)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((str(r["doc_id"]), *r[1:]) for r in found.collect())


def test_hot_group_nulls_and_repeats(spark):
    draw = random.Random(2)
    rows = [(i, "hot", "en", i, f"line {i}\nand more") for i in range(85)]
    rows += [(1000 + i, draw.choice(["a", "é", "z", "", None, "ｚ", "\U0001f600"]), draw.choice(["de", None]), draw.choice([None, 5]), draw.choice([None, "", "\n", "x\n" * 3000, "plain"]))
             for i in range(60)]
    rows += [rows[3], rows[3], (3, "hot", None, 3, "other"), (None, "hot", "en", 1, "a\nb"), (None, "hot", "en", 1, "a\nb"), (None, None, None, None, None), (2**60 + 1, "far", None, -4, "t"), (-5, "far", None, 0, "t\n")]
    draw.shuffle(rows)
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 10])
def test_small_tables(spark, n):
    rows = [(i, "s", None, i, f"a\n{i}") for i in range(n)]
    assert got(spark, rows) == brute(rows)
    single = [(i, f"s{i}", None, i, "a") for i in range(n)]
    assert got(spark, single) == brute(single)


def test_a_proof_fails_for_any_other_leaf(spark):
    from pyspark.sql import functions as F

    rows = [(i, "ab"[i % 2], "en", 1, "t") for i in range(20)]
    made = manifest.build(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"))
    checks = made.proofs.select(manifest.fold(F.col("leaf"), F.col("steps")) == made.root, manifest.fold(manifest.digest(F.lit("x")), F.col("steps")) == made.root).collect()
    assert {tuple(r) for r in checks} == {(True, False)}
