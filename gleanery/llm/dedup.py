"""Near-duplicate documents by b-bit MinHash: band candidates, packed signatures, links confirmed on full sets."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..models.cluster import connected_components
from ..operators.lookup import lookup_join
from ..session import cut
from .common import Hashes, arrow_batch, free_name, numbered, small, texts_of

#: Members of a bucket that meet in one task.
BLOCK = 256


@dataclass(frozen=True)
class MinHash:
    """``bands * rows`` minima of which ``bits`` low bits are kept.

    With 32 bands of 5, a pair at similarity 0.8 shares no band with probability 3e-6. A pair whose estimate lies more
    than ``sigmas`` standard errors below the threshold is not looked at; 6 make that 1e-9.
    """

    words: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 5
    bits: int = 4
    sigmas: float = 6.0
    seed: int = 7

    @property
    def size(self) -> int:
        return self.bands * self.rows

    def families(self) -> tuple[np.ndarray, np.ndarray]:
        draw = np.random.Generator(np.random.Philox(self.seed))
        odd = draw.integers(0, 2**63, self.size, dtype=np.uint64) | np.uint64(1)
        return odd, draw.integers(0, 2**63, self.size, dtype=np.uint64)

    @property
    def least_estimate(self) -> float:
        c = 2.0**-self.bits
        p = self.percent / 100 * (1 - c) + c
        return self.percent / 100 - self.sigmas * math.sqrt(p * (1 - p) / self.size) / (1 - c)


def shingle_set(text: str | None, words: int, hashes: Hashes) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text; fewer words than a shingle are one shingle, none are none."""
    got = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not got:
        return np.zeros(0, np.uint64)
    h = hashes.of(got)
    x = np.full(max(len(h) - words + 1, 1), min(words, len(h)), np.uint64)
    for j in range(min(words, len(h))):
        x = x * np.uint64(0x9E3779B97F4A7C15) ^ h[j:j + len(x)] * np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= x >> np.uint64(29)
    return np.unique(x)


def minima(items: np.ndarray, odd: np.ndarray, add: np.ndarray) -> np.ndarray:
    """32-bit minima of a non-empty set under every hash function, in pieces of bounded size."""
    least = None
    for start in range(0, len(items), 2048):
        here = ((items[start:start + 2048, None] * odd + add) >> np.uint64(32)).min(axis=0)
        least = here if least is None else np.minimum(least, here)
    return least


def packed(least: np.ndarray, bits: int) -> np.ndarray:
    """The low bits of all minima as 64-bit words."""
    lanes = 64 // bits
    low = least & np.uint64((1 << bits) - 1)
    low = np.concatenate([low, np.zeros(-len(low) % lanes, np.uint64)]).reshape(-1, lanes)
    return np.bitwise_or.reduce(low << (np.arange(lanes, dtype=np.uint64) * np.uint64(bits)), axis=1)


def similarity_estimate(a: str, b: str, how: MinHash):
    """Column: similarity by the number of equal lanes in two packed signatures, corrected for chance collisions."""
    ones = sum(1 << i for i in range(0, 64, how.bits))
    ones = ones - (1 << 64) if ones >= 1 << 63 else ones

    def unequal(x, y):
        d = x.bitwiseXOR(y)
        folded = d
        for step in range(1, how.bits):
            folded = folded.bitwiseOR(F.shiftrightunsigned(d, step))
        return F.bit_count(folded.bitwiseAND(F.lit(ones).cast("long")))

    apart = F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda s, v: s + v)
    c = 2.0**-how.bits
    return ((1 - apart / F.lit(float(how.size))) - F.lit(c)) / F.lit(1 - c)


def sketches(docs: DataFrame, how: MinHash, *more: str) -> DataFrame:
    """(doc_id, text_key, digest, n_shingles, bands, signature) of every row; ``text_key`` finds the text again. ``more`` are
    long columns that come along."""
    out = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("digest", pa.string()), ("n_shingles", pa.int64()),
                     ("bands", pa.list_(pa.int64())), ("signature", pa.list_(pa.int64())), *[(c, pa.int64()) for c in more]])

    def run(batches):
        from xxhash import xxh3_64_intdigest, xxh3_128_hexdigest

        hashes, (odd, add) = Hashes(), how.families()
        for part, texts in texts_of(batches):
            digests, sizes, bands, signatures = [], [], [], []
            for text in texts:
                items = shingle_set(text, how.words, hashes)
                sizes.append(len(items))
                if not len(items):
                    digests.append(None), bands.append([]), signatures.append([])
                    continue
                least = minima(items, odd, add)
                digests.append(xxh3_128_hexdigest(items.tobytes()))
                keys = [xxh3_64_intdigest(row.tobytes(), seed=i) for i, row in enumerate(least.reshape(how.bands, how.rows))]
                bands.append(np.array(keys, np.uint64).view(np.int64))
                signatures.append(packed(least, how.bits).view(np.int64))
            yield arrow_batch(out, part.column(0), part.column(1), digests, sizes, bands, signatures, *[part.column(c) for c in more])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text", *more)
    schema = "doc_id long, text_key long, digest string, n_shingles long, bands array<long>, signature array<long>"
    return rows.mapInArrow(run, ", ".join([schema, *[f"{c} long" for c in more]]))


def _bucket_rows(classes: DataFrame) -> DataFrame:
    """(band, node, size, rank) for buckets with two nodes or more; ``rank`` is high for nodes that share many buckets."""
    rows = classes.select(F.explode("bands").alias("band"), "node")
    sizes = rows.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = cut(rows.join(sizes, "band"))
    weight = shared.groupBy("node").agg(F.sum("size").alias("rank"))
    return cut(shared.join(weight, "node").select("band", "node", "size", "rank"))


def _compare(blocks: DataFrame, how: MinHash) -> DataFrame:
    """Links (a, b) between the probes and the members of each block, judged on their full sets.

    ``blocks`` has (block, probe, node, root, text). Members and probes of a block are bounded in number, a probe meets the
    members of other roots only, and nothing but links leaves the task.
    """
    out = pa.schema([("a", pa.string()), ("b", pa.string())])

    def run(_key, data):
        hashes = Hashes(100_000)
        probe = np.array(data["probe"].to_pylist(), bool)
        node, root = np.array(data["node"].to_pylist(), object), np.array(data["root"].to_pylist(), object)
        sets = [shingle_set(t, how.words, hashes) for t in data["text"].to_pylist()]
        members, left, right = np.flatnonzero(~probe), [], []
        if len(members):
            whole, ids = np.unique(np.concatenate([sets[i] for i in members]), return_inverse=True)
            lengths = np.array([len(sets[i]) for i in members])
            starts, seen = np.concatenate([[0], np.cumsum(lengths)[:-1]]), np.zeros(len(whole), np.int64)
            for p in np.flatnonzero(probe):
                at = np.searchsorted(whole, sets[p])
                at = at[(at < len(whole)) & (whole[np.minimum(at, len(whole) - 1)] == sets[p])]
                seen[at] = 1
                both = np.add.reduceat(seen[ids], starts)
                seen[at] = 0
                close = 100 * both >= how.percent * (lengths + len(sets[p]) - both)
                for m in members[close & (root[members] != root[p])]:
                    left.append(node[p]), right.append(node[m])
        return pa.table([pa.array(left, pa.string()), pa.array(right, pa.string())], schema=out)

    links = blocks.groupBy("block").applyInArrow(run, "a string, b string")
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _share(column: str, blocks):
    return F.pmod(F.xxhash64(column, F.lit(11)), blocks)


def _blocks(members: DataFrame, probes: DataFrame, keys: list[str], texts: DataFrame) -> DataFrame:
    """Rows of all blocks. Members are dealt into shares of about ``BLOCK`` rows, probes likewise, and every share of the
    one meets every share of the other; both carry the key, ``node``, ``root``, ``n_members`` and ``n_probes``."""
    parts = {False: F.ceil(F.col("n_members") / BLOCK), True: F.ceil(F.col("n_probes") / BLOCK)}

    def dealt(rows: DataFrame, probe: bool) -> DataFrame:
        own, met = _share("node", parts[probe]), F.explode(F.sequence(F.lit(0).cast("long"), parts[not probe] - 1))
        rows = rows.withColumn("own", own).withColumn("met", met)
        at = ("own", "met") if probe else ("met", "own")
        return rows.select(F.concat_ws(":", *keys, *at).alias("block"), F.lit(probe).alias("probe"), "node", "root")

    rows = dealt(members, False).unionByName(dealt(probes, True))
    return rows.join(texts, "node").select("block", "probe", "node", "root", "text")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text), one text for each wanted class."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").alias("d").join(
        small(wanted).alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.text_key") == F.col("w.text_key")))
    return cut(found.select("w.node", "d.text").groupBy("node").agg(F.any_value("text").alias("text")))


def _links(classes: DataFrame, docs: DataFrame, how: MinHash) -> DataFrame:
    """Confirmed links (a, b) between classes, enough to connect whatever the bands can connect.

    First every node meets, in each of its buckets, the node that shares most buckets with others; packed signatures drop
    the pairs that are far apart. Then nodes that share a bucket and are still apart meet in blocks.
    """
    shared = _bucket_rows(classes)
    texts = _texts(docs, shared.select("node").distinct().join(classes.select("node", "who.doc_id", "who.text_key"), "node"))

    centres = shared.groupBy("band").agg(F.max(F.struct("rank", "node")).alias("top")).select("band", F.col("top.node").alias("centre"))
    pairs = shared.join(centres, "band").filter("node <> centre").select("node", "centre").distinct()
    signed = classes.select("node", "signature")
    pairs = pairs.join(signed, "node").join(signed.select(F.col("node").alias("centre"), F.col("signature").alias("other")), "centre")
    pairs = cut(pairs.filter(similarity_estimate("signature", "other", how) >= how.least_estimate).select("node", "centre"))
    stars = pairs.groupBy("centre").agg(F.count(F.lit(1)).alias("n_members")).withColumn("n_probes", F.lit(1).cast("long"))
    members = pairs.join(stars, "centre").withColumn("root", F.col("node"))
    probes = stars.withColumn("node", F.col("centre")).withColumn("root", F.col("centre"))
    first = cut(_compare(_blocks(members, probes, ["centre"], texts), how))

    roots = connected_components(first)
    placed = cut(shared.filter("size > 2").join(roots, "node", "left").select("band", "node", "size", F.coalesce("root", "node").alias("root")))
    counts = placed.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"))
    split = counts.groupBy("band").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("n_members")).filter("most.n < n_members")
    split = split.select("band", F.col("most.root").alias("main"), "n_members", (F.col("n_members") - F.col("most.n")).alias("n_probes"))
    members = placed.join(split, "band")
    rest = _compare(_blocks(members, members.filter("root <> main"), ["band"], texts), how)
    return cut(first.unionByName(rest))


def _named(rows: DataFrame, docs: DataFrame, how: MinHash, least: Column) -> DataFrame:
    """(node, root, ``least``, copies, linked) of every class of the sketched ``rows``; ``least`` is an aggregate over its rows."""
    classes = cut(rows.filter(F.col("digest").isNotNull()).groupBy(F.col("digest").alias("node")).agg(
        least, F.min(F.struct("doc_id", "text_key")).alias("who"), F.count(F.lit(1)).alias("copies"),
        F.any_value("bands").alias("bands"), F.any_value("signature").alias("signature")))
    roots = connected_components(_links(classes, docs, how))
    name = classes.columns[1]
    return classes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), name, "copies", F.col("root").isNotNull().alias("linked"))


def near_duplicates(docs: DataFrame, how: MinHash = MinHash()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each input row.

    Documents with the same shingle set form a class; classes are linked when 100 * |A & B| >= percent * |A | B|. The
    component of a document is the smallest doc_id it is connected to. Null texts and texts without words have no shingles and no
    links; repeated rows are one class and each come back; a row without doc_id never names a component unless nothing
    else does, and then ``component_id`` is null. An empty table gives an empty result. Columns other than doc_id and
    text are not read. Candidates come from bands, so two linked texts are missed with the probability that ``MinHash``
    states; no bucket is cut.
    """
    rows = cut(sketches(docs, how))
    named = _named(rows, docs, how, F.min("doc_id").alias("least_id"))
    ids = named.filter("linked").groupBy("root").agg(F.min("least_id").alias("root_id"))
    facts = cut(named.filter("linked or copies > 1").join(ids, "root", "left").select(
        F.col("node").alias("digest"), "copies", F.coalesce("root_id", "least_id").alias("named_id")))
    sizes = facts.agg(F.count(F.lit(1)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    found = lookup_join(rows.select("doc_id", "n_shingles", "digest"), facts, "digest", "copies", ["named_id"], sizes[0], sizes[1])
    component = F.when(F.col("named_id").isNotNull(), F.col("named_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one_of_each(docs: DataFrame, how: MinHash = MinHash()) -> DataFrame:
    """The rows of ``docs`` that stand for their component, one for each: the one with the smallest doc_id, and a row without
    one only where no other has any. Rows are told apart by a number of their own, so different texts stay whether they share
    a doc_id or have none. Texts without words have no links; of those that repeat a doc_id and a text one stays."""
    known, names = numbered(docs, "_dedup")
    row = free_name(known, "_dedup_row")
    rows = cut(sketches(known, how, *names).withColumn(row, F.struct(*names)))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "digest", "text_key", row)
    named = cut(_named(rows, known, how, F.min(order).alias("first")))
    firsts = named.filter("linked").groupBy("root").agg(F.min("first").alias("root_first"))
    linked = named.filter("linked or copies > 1").join(firsts, "root", "left").select(
        F.col("node").alias("key"), "copies", F.coalesce("root_first", "first")[row].alias("stays"))
    # A row without words and doc_id has no key: nothing says that it repeats another.
    keyed = rows.select(row, F.coalesce("digest", F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("text_key").cast("string"))).alias("key"), "digest")
    wordless = keyed.filter(F.col("digest").isNull() & F.col("key").isNotNull()).groupBy("key").agg(
        F.count(F.lit(1)).alias("copies"), F.min(row).alias("stays")).filter("copies > 1")
    facts = cut(linked.unionByName(wordless))
    sizes = facts.agg(F.count(F.lit(1)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    found = lookup_join(keyed.select(row, "key"), facts, "key", "copies", ["stays"], sizes[0], sizes[1])
    dropped = small(found.filter(F.col("stays") != F.col(row)).select(F.col(f"{row}.*")))
    return known.join(dropped, names, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
