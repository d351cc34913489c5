"""Merkle manifest of a dataset: a tree of digests per group, one tree over the groups, and a proof for every row.

A level is one aggregation: each parent's children are spread into ``FANOUT`` slot columns. All slots concatenated give the
parent's digest, all but a child's own give its siblings. Proofs go down the same tables, so texts are read once and
never shuffled, and no group of rows is larger than ``FANOUT``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut
from .common import small_bytes

FANOUT = 3
SLOTS = [f"s{k}" for k in range(FANOUT)]


@dataclass(frozen=True)
class Manifest:
    """``root`` is null for an empty dataset. ``proofs`` has (key, leaf, subroot, steps, ...), one row for each input row; a
    step holds the digests to the ``left`` and to the ``right`` of the way up, lowest level first."""

    root: str | None
    proofs: DataFrame


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def shown(digests: Column) -> Column:
    """Digests as lowercase hex; of several in a row, their texts in a row."""
    return F.lower(F.hex(digests))


def record(fields: list[Column]) -> Column:
    """The digest of a row: every field as ``-`` if null, else its UTF-8 byte count, ``:`` and the value."""
    texts = [f.cast("string") for f in fields]
    return digest(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]))


def fold(leaf: Column, steps: Column) -> Column:
    """The root (hex) that a leaf and its proof lead to."""
    return F.aggregate(steps, shown(leaf), lambda h, s: F.sha2(F.concat(shown(s["left"]), h, shown(s["right"])), 256))


def siblings(steps: Column) -> Column:
    """All digests of a proof as hex, level by level, left to right."""
    return F.array_join(F.transform(steps, lambda s: shown(F.concat(s["left"], s["right"]))), "")


def _positions(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``rows`` with ``pos``, the rank from 0 within ``tree``, and ``n``, the tree's size; and the largest size.

    Rows are dealt by range and sorted there, so a tree that owns most rows is numbered by many tasks. Equal rows are dealt by
    a number of their own.
    """
    keys = ["tree", *order, "tie"]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
    placed = cut(dealt.withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))
    counts = placed.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("here"), F.min("at").alias("first"))
    parts = Window.partitionBy("tree")
    before = F.coalesce(F.sum("here").over(parts.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = cut(counts.select("tree", "part", (before - F.col("first")).alias("offset"), F.sum("here").over(parts).alias("n")))
    most = offsets.agg(F.max("n")).first()[0] or 0
    numbered = placed.join(small_bytes(offsets), ["tree", "part"])
    return numbered.withColumn("pos", F.col("at") + F.col("offset")).drop("at", "part", "offset"), most


def _levels(nodes: DataFrame, most: int) -> list[DataFrame]:
    """One table per level above the nodes: (tree, pos, n, hash) of each parent with its children in the slot columns.

    ``n`` is the number of nodes that the tree has on that level; a tree goes up until it has one.
    """
    tables = []
    while most > 1:
        here = nodes.filter("n > 1").groupBy("tree", F.expr(f"pos div {FANOUT}").alias("pos")).agg(
            F.ceil(F.max("n") / FANOUT).cast("long").alias("n"),
            *[F.max(F.when(F.col("pos") % FANOUT == k, F.col("node"))).alias(s) for k, s in enumerate(SLOTS)])
        tables.append(cut(here.withColumn("hash", digest(F.concat_ws("", *[shown(F.col(s)["hash"]) for s in SLOTS])))))
        nodes = tables[-1].select("tree", "pos", "n", F.struct("hash").alias("node"))
        most = -(-most // FANOUT)
    return tables


def _roots(nodes: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """(tree, hash), one row for each tree."""
    found = nodes.filter("n = 1").select("tree", F.col("node.hash").alias("hash"))
    for table in tables:
        found = found.unionByName(table.filter("n = 1").select("tree", "hash"))
    return found


def _ways(nodes: DataFrame, tables: list[DataFrame], starts: DataFrame) -> DataFrame:
    """(tree, node, steps, ...) of every node: its siblings on all levels, and then those that ``starts`` has for its tree."""
    none = F.lit(bytearray())
    beside = lambda slots: F.concat(none, *[F.coalesce(F.col(s)["hash"], none) for s in slots])
    carried = [c for c in starts.columns if c not in ("tree", "steps")]
    above = None
    for table in reversed(tables):
        tops = table.filter("n = 1").select("tree", "pos").join(starts, "tree")
        above = tops if above is None else tops.unionByName(above)
        children = F.array(*[F.struct((F.col("pos") * FANOUT + k).alias("pos"), F.col(s).alias("node"), F.struct(
            beside(SLOTS[:k]).alias("left"), beside(SLOTS[k + 1:]).alias("right")).alias("step")) for k, s in enumerate(SLOTS)])
        children = table.drop("n", "hash").join(above, ["tree", "pos"]).select("tree", "steps", *carried, F.explode(children).alias("child"))
        below = children.filter("child.node is not null").select(
            "tree", "child.pos", "child.node", F.concat(F.array("child.step"), "steps").alias("steps"), *carried)
        above = below.drop("node")
    alone = nodes.filter("n = 1").select("tree", "node").join(starts, "tree").select("tree", "node", "steps", *carried)
    return alone.unionByName(below.drop("pos")) if tables else alone


def build(docs: DataFrame, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
          extra: dict[str, Column] | None = None) -> Manifest:
    """The manifest of ``docs`` with a proof for every row.

    Rows of a group are leaves in the order of ``key`` (null first), equal keys in the order of their digests; groups follow one another by
    their UTF-8 bytes, a null one first. While several nodes are left, every ``FANOUT`` neighbours become the
    digest of their digests (the last run may be shorter, even one), in each group and then over the groups. Null fields are
    marked and differ from empty ones; repeated rows are leaves of their own; an empty table has no root and no
    proofs. ``extra`` are columns over ``docs`` that come along under names of the caller; other columns are not read.
    """
    extra = extra or {}
    tree = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("v"), F.col(group).cast("string")))
    leaves = cut(docs.select(tree.alias("tree"), F.col(key).alias("key"), record([F.col(f) for f in fields]).alias("hash"),
                             F.struct(F.lit(0).alias("_"), *[c.alias(n) for n, c in extra.items()]).alias("extra")))
    ranked, most = _positions(leaves, ["key", "hash"])
    nodes = ranked.select("tree", "pos", "n", F.struct("hash", "key", "extra").alias("node"))
    tables = _levels(nodes, most)

    tops, groups = _positions(cut(_roots(nodes, tables)).select(F.lit("").alias("tree"), F.col("tree").alias("group"), "hash"), ["group"])
    upper = tops.select("tree", "pos", "n", F.struct("hash", "group").alias("node"))
    over = _levels(upper, groups)
    root = _roots(upper, over).select(shown(F.col("hash"))).first()
    spark = docs.sparkSession
    first = spark.createDataFrame([("", [])], "tree string, steps array<struct<left binary, right binary>>")
    starts = cut(_ways(upper, over, first).select(F.col("node.group").alias("tree"), F.col("node.hash").alias("subroot"), "steps"))
    ways = _ways(nodes, tables, small_bytes(starts))
    return Manifest(root[0] if root else None, ways.select(
        F.col("node.key").alias("key"), F.col("node.hash").alias("leaf"), "subroot", "steps", *[F.col("node.extra")[n].alias(n) for n in extra]))


def audit(docs: DataFrame) -> DataFrame:
    """Build the manifest, tamper with half of the rows, and check every row against its original proof.

    (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row for each input row. Where 2 divides the crc32 of doc_id, the
    line feeds of the text are deleted before the row is hashed anew; a row without doc_id is left as it is, and
    so is a null text. Nulls, repeated rows and an empty table are as in ``build``.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "n_chars", "text")
    changed = record([F.col(c) for c in ("doc_id", "source", "lang", "n_chars")] + [F.translate("text", "\n", "")])
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    made = build(rows, extra={"changed": F.when(hit & F.contains("text", F.lit("\n")), changed)})
    folded = fold(F.coalesce("changed", "leaf"), F.col("steps"))
    return made.proofs.select(
        F.col("key").alias("doc_id"), shown(F.col("leaf")).alias("leaf"), shown(F.col("subroot")).alias("subroot"), F.lit(made.root).cast("string").alias("root"),
        F.sha2(siblings(F.col("steps")), 256).alias("proof_sha256"), folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
