"""Exact Jaccard join of word n-gram sets by T-occurrence search over inverted lists.

Two sets that are similar enough share an n-gram among the rarest few of each, fewer still of the smaller one, so the lists of those
n-grams bring candidates together. Bit parities rule out most pairs without their sets. For the rest, blocks of sets are
indexed and searched with DivideSkip: short lists are merged by a heap, long ones probed by binary search, and documents
that reach the required overlap are kept. Only links that can still connect something are looked for; no pair that the
lists hold is dropped.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..models.cluster import connected_components
from ..operators.lookup import lookup_join
from ..session import cut
from .common import arrow_batch, small_bytes, texts_of
from .dedup import shingle_set

#: Sets that meet in one task, and the length up to which the pairs of a list are written without a look at parities.
BLOCK, SHORT_LIST = 256, 8
#: Fewest 64-bit words of the parities of a set.
PARITY = 16
#: n-grams of a task that are counted at once.
COUNTED = 4_000_000


@dataclass(frozen=True)
class Join:
    """Sets of distinct ``words``-grams with 100 * |A & B| >= ``percent`` * |A | B|.

    The ``frequent`` most frequent n-grams come last in the order that says which ones are rare, the others first by their hash. Any
    order gives the same links; this one keeps common passages out of the candidate lists.
    """

    words: int = 4
    percent: int = 85
    frequent: int = 1 << 20

    def least(self, n):
        """The smallest overlap that a set of ``n`` can have with any similar set; arrays, columns and numbers alike."""
        return -(-self.percent * n // 100)

    def needed(self, n, m):
        return -(-self.percent * (n + m) // (100 + self.percent))


# ---------------------------------------------------------------- T-occurrence search

class Lists:
    """Inverted lists of a block of sets, numbered by size."""

    def __init__(self, sets: list[np.ndarray], how: Join):
        self.how, self.order = how, np.argsort([len(s) for s in sets], kind="stable")
        self.sizes = np.array([len(sets[i]) for i in self.order], np.int64)
        items = np.concatenate([sets[i] for i in self.order])
        members = np.repeat(np.arange(len(sets)), self.sizes)
        by = np.argsort(items, kind="stable")
        self.items, number = np.unique(items[by], return_inverse=True)
        self.entries = number * len(sets) + members[by]

    def search(self, probe: np.ndarray) -> np.ndarray:
        """The sets of the block that are similar to ``probe``."""
        n, how, total = len(probe), self.how, len(self.sizes)
        low = int(np.searchsorted(self.sizes, how.least(n)))
        high = int(np.searchsorted(self.sizes, 100 * n // how.percent, "right"))
        if low >= high:
            return np.zeros(0, np.int64)
        at = np.searchsorted(self.items, probe)
        at = at[at < len(self.items)][self.items[at[at < len(self.items)]] == probe[at < len(self.items)]]
        start, stop = np.searchsorted(self.entries, at * total + low), np.searchsorted(self.entries, at * total + high)
        full = stop > start
        at, start, stop = at[full], start[full], stop[full]
        need = how.needed(n, int(self.sizes[low]))
        if len(at) < need:
            return np.zeros(0, np.int64)
        by = np.argsort(start - stop, kind="stable")
        longest = int(stop[by[0]] - start[by[0]])
        n_long = min(need - 1, int(need / (0.0085 * math.log2(longest) + 1))) if longest > 1 else 0
        short, probed = by[n_long:], at[by[:n_long]] * total
        found = []
        lists = [(self.entries[start[i]:stop[i]] - at[i] * total).tolist() for i in short]
        for member, seen in merge_skip(lists, need - n_long):
            keys = probed + member
            where = np.minimum(np.searchsorted(self.entries, keys), len(self.entries) - 1)
            both = seen + int((self.entries[where] == keys).sum())
            if both >= how.needed(n, int(self.sizes[member])):
                found.append(member)
        return self.order[np.array(found, np.int64)]


def merge_skip(lists: list[list[int]], need: int):
    """(member, number of lists that hold it) where at least ``need`` do. Where the smallest head is in too few lists, as many
    heads as could not reach ``need`` jump to the next one that can."""
    need = max(need, 1)
    at, heap = [0] * len(lists), [(ids[0], i) for i, ids in enumerate(lists)]
    heapq.heapify(heap)
    while len(heap) >= need:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= need:
            yield top, len(popped)
            goal = top + 1
        else:
            while heap and len(popped) < need - 1:
                popped.append(heapq.heappop(heap)[1])
            if not heap:
                return
            goal = heap[0][0]
        for i in popped:
            ids, j = lists[i], at[i]
            step = 1
            while j + step < len(ids) and ids[j + step] < goal:
                j, step = j + step, step * 2
            while j < len(ids) and ids[j] < goal:
                j += 1
            at[i] = j
            if j < len(ids):
                heapq.heappush(heap, (ids[j], i))


# ---------------------------------------------------------------- sets, orders, candidates

class WordHashes:
    """64-bit hashes of words, without a memory."""

    def __init__(self):
        from xxhash import xxh64_intdigest
        self.digest = xxh64_intdigest

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.digest, words), np.uint64, len(words))


def parities(items: np.ndarray) -> np.ndarray:
    """Whether an odd number of items falls into each of at least two places an item. Two sets differ in at least as many items as
    places; parities of twice the length fold to the shorter ones by exclusive or of their halves."""
    bits = max(64 * PARITY, 1 << (2 * len(items) - 1).bit_length())
    odd = np.bincount((items & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def folded(parity: np.ndarray) -> np.ndarray:
    half = parity.shape[-1] // 2
    return parity[..., :half] ^ parity[..., half:]


def _may_link(n: Column, m: Column, a: Column, b: Column, how: Join) -> Column:
    """Whether sizes and parities leave room for a link."""
    xor = lambda x, y: x.bitwiseXOR(y)
    at_most = lambda x, y: F.when(F.size(x) > F.size(y), F.zip_with(F.slice(x, 1, F.size(y)), F.slice(x, F.size(y) + 1, F.size(y)), xor)).otherwise(x)
    apart = F.aggregate(F.zip_with(at_most(a, b), at_most(b, a), lambda x, y: F.bit_count(xor(x, y))), F.lit(0), lambda s, v: s + v)
    need = F.ceil(F.lit(how.percent) * (n + m) / F.lit(100 + how.percent))
    # Sets of similar sizes have parities of equal length or of twice the length.
    return F.when(100 * F.least(n, m) >= how.percent * F.greatest(n, m), apart <= n + m - 2 * need).otherwise(False)


def frequent_ngrams(docs: DataFrame, how: Join) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams found in most texts, sorted, and their counts; at most ``how.frequent``, so 16 MB.

    Tasks count what occurs in two different texts of theirs or more. The counts only order n-grams.
    """
    def run(batches):
        from xxhash import xxh3_64_intdigest

        hashes, held, size, seen = WordHashes(), [], 0, set()

        def counted():
            items, counts = np.unique(np.concatenate(held), return_counts=True)
            items, counts = items[counts > 1], counts[counts > 1]
            return pa.record_batch([pa.array(items.view(np.int64)), pa.array(counts)], names=["item", "texts"])

        for _, texts in texts_of(batches):
            for text in texts:
                items = shingle_set(text, how.words, hashes)
                name = xxh3_64_intdigest(items.tobytes())
                if len(items) and name not in seen:
                    seen.add(name)
                    held.append(items)
                    size += len(items)
                    if size > COUNTED:
                        yield counted()
                        held, size, seen = [], 0, set()
        if held:
            yield counted()

    sums = cut(docs.select("text").mapInArrow(run, "item long, texts long").groupBy("item").agg(F.sum("texts").alias("texts")))
    level = F.floor(F.log2("texts") * 4)
    levels = sums.groupBy(level.alias("level")).count().orderBy(F.col("level").desc()).collect()
    total, least = 0, None
    for row in levels:
        total += row["count"]
        if total > how.frequent:
            break
        least = row["level"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rows = sums.filter(level >= least).toArrow()
    items, texts = rows["item"].to_numpy().view(np.uint64), rows["texts"].to_numpy()
    order = np.argsort(items)
    return items[order], texts[order]


def _sets(docs: DataFrame, how: Join) -> DataFrame:
    """(doc_id, text_key, node, digest, n, rare, parity) of every row, ``node`` being its number; ``rare`` are the n-grams of which any similar
    set shares one, rarest first."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_ngrams(docs, how))
    out = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("node", pa.int64()), ("digest", pa.string()), ("n", pa.int64()),
                     ("rare", pa.list_(pa.int64())), ("parity", pa.list_(pa.int64()))])

    def run(batches):
        from xxhash import xxh3_128_hexdigest

        hashes, (common, texts) = WordHashes(), frequent.value
        often = np.zeros(1 << 22, bool)
        often[common >> np.uint64(42)] = True
        for part, rows in texts_of(batches):
            digests, sizes, rare, parity = [], [], [], []
            for text in rows:
                items = shingle_set(text, how.words, hashes)
                sizes.append(len(items))
                if not len(items):
                    digests.append(None), rare.append([]), parity.append([])
                    continue
                first, maybe = items, np.flatnonzero(often[items >> np.uint64(42)])
                if len(maybe):
                    at = np.minimum(np.searchsorted(common, items[maybe]), len(common) - 1)
                    found = np.zeros(len(items), np.int64)
                    found[maybe] = np.where(common[at] == items[maybe], texts[at], 0)
                    first = items[np.argsort(found, kind="stable")]
                digests.append(xxh3_128_hexdigest(items.tobytes()))
                rare.append(first[:len(items) - how.least(len(items)) + 1].view(np.int64))
                parity.append(parities(items).view(np.int64))
            yield arrow_batch(out, part.column(0), part.column(1), part.column(2), digests, sizes, rare, parity)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.monotonically_increasing_id().alias("node"), "text")
    return cut(rows.mapInArrow(run, "doc_id long, text_key long, node long, digest string, n long, rare array<long>, parity array<long>"))


class FullSets:
    """(node, items) of the nodes that were asked for; texts are read again for those that are new."""

    def __init__(self, docs: DataFrame, facts: DataFrame, how: Join):
        self.docs, self.facts, self.how, self.table = docs, facts, how, None

    def of(self, nodes: DataFrame) -> DataFrame:
        wanted = nodes.select("node").distinct()
        wanted = cut(wanted if self.table is None else wanted.join(self.table.select("node"), "node", "left_anti"))
        if self.table is None or not wanted.isEmpty():
            fresh = self._read(cut(self.facts.select("node", "who", "copies").join(wanted, "node")))
            self.table = fresh if self.table is None else self.table.unionByName(fresh)
        return self.table

    def _read(self, wanted: DataFrame) -> DataFrame:
        how, schema = self.how, pa.schema([("node", pa.int64()), ("copies", pa.int64()), ("items", pa.binary())])
        texts = self.docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").alias("d")
        met = texts.join(small_bytes(wanted).alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.who.doc_id")) & (F.col("d.text_key") == F.col("w.who.text_key")))

        def run(batches):
            hashes = WordHashes()
            for part, rows in texts_of(batches):
                yield arrow_batch(schema, part.column(0), part.column(1), [shingle_set(t, how.words, hashes).tobytes() for t in rows])

        # A class of several rows may be found several times.
        once = met.filter("w.copies = 1").select("w.node", "w.copies", "d.text")
        more = met.filter("w.copies > 1").select("w.node", "w.copies", "d.text").groupBy("node", "copies").agg(F.any_value("text").alias("text"))
        return cut(once.unionByName(more).mapInArrow(run, "node long, copies long, items binary").select("node", "items"))


# ---------------------------------------------------------------- links

def _shares(n: Column) -> Column:
    return F.ceil(n / BLOCK)


def _share_of(node: str, shares: Column) -> Column:
    return F.pmod(F.xxhash64(node, F.lit(5)), shares)


def _every(shares: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), shares - 1))


def _stars(pairs: DataFrame, sets: FullSets, how: Join) -> DataFrame:
    """The (node, centre) pairs that are links, as (a, b). Each centre probes its nodes, in shares of about ``BLOCK``."""
    def run(_key, data):
        node, probe = data["node"].to_numpy(), data["probe"].to_numpy(zero_copy_only=False)
        items = [np.frombuffer(x.as_buffer(), np.uint64) for x in data["items"]]
        members, left, right = np.flatnonzero(~probe), [], []
        if len(members):
            lists = Lists([items[i] for i in members], how)
            for p in np.flatnonzero(probe):
                near = node[members[lists.search(items[p])]]
                left += [node[p]] * len(near)
                right += near.tolist()
        return pa.table([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    shares = _shares(F.col("members"))
    sizes = pairs.groupBy("centre").agg(F.count(F.lit(1)).alias("members"))
    members = pairs.join(sizes, "centre").select("centre", _share_of("node", shares).alias("share"), F.lit(False).alias("probe"), "node")
    probes = sizes.select("centre", _every(shares).alias("share"), F.lit(True).alias("probe"), F.col("centre").alias("node"))
    full = sets.of(pairs.select("node").unionByName(pairs.select(F.col("centre").alias("node"))))
    blocks = members.unionByName(probes).join(full, "node")
    return cut(blocks.groupBy("centre", "share").applyInArrow(run, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def _near(lists: DataFrame, facts: DataFrame, how: Join) -> DataFrame:
    """The pairs (node, centre) that share a list, are apart, and that sizes and parities leave open.

    ``lists`` has (item, node, root). In a list the nodes outside its largest group meet all, in blocks of bounded size.
    """
    def run(_key, data):
        probe, root, n, node = (data[c].to_numpy(zero_copy_only=False) for c in ("probe", "root", "n", "node"))
        parity, left, right = [np.array(x.values, np.int64).view(np.uint64) for x in data["parity"]], [], []
        sizes = np.array([len(x) for x in parity])
        members = {}
        for size in np.unique(sizes[~probe]):
            own = np.flatnonzero(~probe & (sizes == size))
            members[int(size)] = own, np.stack([parity[i] for i in own])
        for p in np.flatnonzero(probe):
            mine = parity[p]
            for size, (own, theirs) in members.items():
                if size not in (len(mine), 2 * len(mine), len(mine) // 2):
                    continue
                one, many = (folded(mine), theirs) if size < len(mine) else (mine, folded(theirs)) if size > len(mine) else (mine, theirs)
                fits = (100 * np.minimum(n[own], n[p]) >= how.percent * np.maximum(n[own], n[p])) & (root[own] != root[p])
                near = node[own[fits & (np.bitwise_count(many ^ one).sum(axis=1) <= n[own] + n[p] - 2 * how.needed(n[own], n[p]))]]
                left += np.minimum(near, node[p]).tolist()
                right += np.maximum(near, node[p]).tolist()
        return pa.table([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["node", "centre"])

    counts = lists.groupBy("item", "root").agg(F.count(F.lit(1)).alias("here"))
    split = counts.groupBy("item").agg(F.max(F.struct("here", "root")).alias("most"), F.sum("here").alias("all")).filter("most.here < all")
    split = split.select("item", F.col("most.root").alias("main"), _shares(F.col("all")).alias("parts"), _shares(F.col("all") - F.col("most.here")).alias("probes"))
    met = lists.join(split, "item").join(facts.select("node", "n", "parity"), "node")
    columns = ["item", "node", "root", "n", "parity"]
    members = met.select(*columns, F.lit(False).alias("probe"), _share_of("node", F.col("parts")).alias("x"), _every(F.col("probes")).alias("y"))
    probes = met.filter("root <> main").select(*columns, F.lit(True).alias("probe"), _every(F.col("parts")).alias("x"), _share_of("node", F.col("probes")).alias("y"))
    return members.unionByName(probes).groupBy("item", "x", "y").applyInArrow(run, "node long, centre long").distinct()


def _roots(links: DataFrame) -> DataFrame:
    return connected_components(links).select(F.col("node").cast("long").alias("node"), F.col("root").cast("long").alias("root"))


def _links(classes: DataFrame, docs: DataFrame, how: Join) -> DataFrame:
    """Links (a, b) between classes of equal sets, enough to connect all that are connected.

    Of two similar sets the smaller one has a shared n-gram among its first few, those that ``index`` marks. Where one set
    alone marks an n-gram, the others of the list meet that one. In other lists all meet the node that shares most; where
    nodes are still apart then, all pairs of short lists meet, and in longer ones another centre. What is apart after
    that is compared by parities in blocks.
    """
    n = F.col("n")
    marked = n - F.ceil(F.lit(2 * how.percent) * n / F.lit(100 + how.percent)) + 1
    rows = classes.select("node", marked.alias("marked"), F.posexplode("rare").alias("place", "item")).select("item", "node", (F.col("place") < F.col("marked")).alias("index"))
    marks = rows.filter("index").groupBy("item").agg(F.count(F.lit(1)).alias("marks"), F.min("node").alias("only"))
    shared = cut(rows.select("item", "node").join(marks, "item").filter("marks > 1 or node <> only"))
    alone = shared.filter("marks = 1").select("node", F.col("only").alias("centre"))
    lists = shared.filter("marks > 1").select("item", "node")
    lists = cut(lists.join(lists.groupBy("item").agg(F.count(F.lit(1)).alias("size")), "item"))
    weight = lists.groupBy("node").agg(F.sum("size").alias("rank"))
    nodes = alone.select("node").unionByName(alone.select(F.col("centre").alias("node"))).unionByName(lists.select("node")).distinct()
    facts = cut(classes.select("node", "n", "parity", "who", "copies").join(nodes, "node").join(weight, "node", "left"))
    sets = FullSets(docs, facts, how)

    def open_pairs(pairs: DataFrame) -> DataFrame:
        one = facts.select("node", "n", "parity")
        other = facts.select(F.col("node").alias("centre"), F.col("n").alias("m"), F.col("parity").alias("other"))
        met = pairs.distinct().join(one, "node").join(other, "centre")
        return cut(met.filter(_may_link(F.col("n"), F.col("m"), F.col("parity"), F.col("other"), how)).select("node", "centre"))

    ranked = cut(lists.join(facts.select("node", "rank"), "node"))

    def apart(links: DataFrame) -> DataFrame:
        """The rows of lists whose nodes are not all connected."""
        placed = ranked.filter("size > 2").join(_roots(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
        split = placed.groupBy("item").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
        return cut(placed.join(split.select("item"), "item"))

    def meeting(rows: DataFrame) -> DataFrame:
        """Every node of a list with the one that shares most."""
        top = rows.groupBy("item").agg(F.max(F.struct("rank", "node")).alias("top")).select("item", F.col("top.node").alias("centre"))
        return rows.join(top, "item").filter("node <> centre").select("node", "centre")

    links = _stars(open_pairs(alone.unionByName(meeting(ranked))), sets, how)

    rows = apart(links)
    short = rows.filter(F.col("size") <= SHORT_LIST)
    one, two = short.select("item", "node", "root"), short.select("item", F.col("node").alias("centre"), F.col("root").alias("other"))
    pairs = one.join(two, "item").filter("node < centre and root <> other").select("node", "centre")
    # In long lists all of other groups meet the best node outside the first one's group.
    long = rows.filter(F.col("size") > SHORT_LIST)
    first = long.groupBy("item").agg(F.max_by("root", F.struct("rank", "node")).alias("led"))
    rest = long.join(first, "item").filter("root <> led")
    second = rest.groupBy("item").agg(F.max(F.struct("rank", "node", "root")).alias("top")).select("item", F.col("top.node").alias("centre"), F.col("top.root").alias("other"))
    pairs = pairs.unionByName(long.join(second, "item").filter("root <> other").select("node", "centre"))
    links = cut(links.unionByName(_stars(open_pairs(pairs), sets, how)))

    long = apart(links).filter(F.col("size") > SHORT_LIST).select("item", "node", "root")
    return cut(links.unionByName(_stars(cut(_near(long, facts, how)), sets, how)))


def ngram_components(docs: DataFrame, how: Join = Join()) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each input row.

    Two rows are linked when their sets of distinct word n-grams are similar enough (see ``Join``); the component is the smallest doc_id that links
    reach, its own included. A text with fewer words than an n-gram is one n-gram; a null text, or one without words, has none
    and no links. Equal sets are one class and each row of it comes back; a row without doc_id names a component only
    where no other row does, and then ``component_id`` is null. An empty table gives an empty result; columns other
    than doc_id and text are not read.
    """
    rows = _sets(docs, how)
    repeated = cut(rows.filter(F.col("digest").isNotNull()).groupBy("digest").agg(
        F.min("node").alias("first"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")).filter("copies > 1"))
    sizes = repeated.agg(F.count(F.lit(1)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    told = lookup_join(rows.filter(F.col("digest").isNotNull()), repeated.withColumn("times", F.col("copies")), "digest", "copies", ["first", "least", "times"], *sizes)
    classes = told.filter("first is null or first = node").select(
        "digest", "node", F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("least_id"), F.struct("doc_id", "text_key").alias("who"),
        F.coalesce("times", F.lit(1).cast("long")).alias("copies"), "n", "rare", "parity")
    roots = _roots(_links(classes, docs, how))
    named = cut(classes.select("digest", "node", "least_id", "copies").join(roots, "node", "left").select(
        "digest", F.coalesce("root", "node").alias("root"), "least_id", "copies", F.col("root").isNotNull().alias("linked")).filter("linked or copies > 1"))
    ids = named.filter("linked").groupBy("root").agg(F.min("least_id").alias("root_id"))
    facts = cut(named.join(ids, "root", "left").select("digest", "copies", F.coalesce("root_id", "least_id").alias("named_id")))
    sizes = facts.agg(F.count(F.lit(1)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    found = lookup_join(rows.select("doc_id", F.col("n").alias("n_shingles"), "digest"), facts, "digest", "copies", ["named_id"], *sizes)
    return found.select("doc_id", "n_shingles", F.coalesce("named_id", "doc_id").alias("component_id"))
