"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, counted over a corpus by pair bitmaps.

A byte-level BPE (A) and a SentencePiece BPE (B) cut the same bytes. Both always cut before a space that follows a word, so a
word is encoded and aligned once per task. The documents of a pair of ids are a compressed bitmap per chunk of rows: the
OR of the bitmaps of all words that link the pair. Multiplicity planes hold, bit by bit, how many links more than one a document has.
Cardinalities add up to corpus counts, and the postings, joined to them, give every document its scores back.
"""

from __future__ import annotations

import json
import re
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut
from .common import texts_of
from .tokencount import words_are_separate

#: Rows of a chunk (13 bits), and bytes of a full bitmap; smaller sets are sorted lists of 16-bit numbers.
CHUNK, FULL = 8192, 1024
#: Bits of an id of B in a pair's code.
B_BITS = 20
#: (pair, row) entries that a task gathers before it writes a chunk.
ENTRIES = 4_000_000

_CUT = re.compile(r"(?<=\S) |(?<=[^ ]) (?=\S)")
_ODD = re.compile(r"\s \s|  ")


def units_of(text: str) -> list[str]:
    """A space and the text, cut where a token of either tokenizer must end: before a space after something that is no space,
    unless white space stands on both sides."""
    text = " " + text
    if text[1:2] != " " and not _ODD.search(text):
        return [" " + word for word in text[1:].split(" ")]
    cuts = [0, *[m.start() for m in _CUT.finditer(text, 1)], len(text)]
    return [text[i:j] for i, j in zip(cuts, cuts[1:])]


# ---------------------------------------------------------------- compressed bitmaps

def pack(row: np.ndarray, member: np.ndarray, rows: int) -> tuple[pa.Array, np.ndarray]:
    """The bitmaps of ``rows`` sets, given (row, member) sorted and distinct, and the number of members of each."""
    counts = np.bincount(row, minlength=rows)
    whole = counts >= FULL // 2
    sizes = np.where(whole, FULL, counts * 2)
    ends = np.cumsum(sizes)
    data, is_list = np.zeros(int(ends[-1]) if rows else 0, np.uint8), np.repeat(~whole, sizes)
    listed = ~whole[row]
    data[is_list] = member[listed].astype("<u2").view(np.uint8)
    dense, places = member[~listed], np.cumsum(whole)[row[~listed]] - 1
    bits = np.zeros(int(whole.sum()) * FULL, np.uint8)
    np.bitwise_or.at(bits, places * FULL + (dense >> 3), (1 << (dense & 7)).astype(np.uint8))
    data[~is_list] = bits
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(data)]), counts


def unpack(bitmaps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, member) of all sets; the reverse of ``pack`` up to the order of rows."""
    if not len(bitmaps):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    offsets = np.frombuffer(bitmaps.buffers()[1], np.int32)[bitmaps.offset:bitmaps.offset + len(bitmaps) + 1]
    data, sizes = np.frombuffer(bitmaps.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]], np.diff(offsets)
    whole, numbers = sizes == FULL, np.arange(len(sizes))
    is_list = np.repeat(~whole, sizes)
    rows, members = [np.repeat(numbers[~whole], sizes[~whole] // 2)], [data[is_list].view("<u2").astype(np.int64)]
    dense, owner = data[~is_list].reshape(-1, FULL), numbers[whole]
    for start in range(0, len(dense), 1024):
        r, m = np.nonzero(np.unpackbits(dense[start:start + 1024], axis=1, bitorder="little"))
        rows.append(owner[start + r]), members.append(m)
    return np.concatenate(rows), np.concatenate(members)


def planes_of(row: np.ndarray, member: np.ndarray, more: np.ndarray, rows: int) -> pa.Array:
    """For each set its multiplicity planes: plane k holds the members whose ``more`` has bit k."""
    depth = int(more.max()).bit_length() if len(more) else 0
    set_row, set_bit, set_member = [], [], []
    for k in range(depth):
        hit = (more >> k) & 1 == 1
        set_row.append(row[hit]), set_bit.append(np.full(int(hit.sum()), k)), set_member.append(member[hit])
    row, bit, member = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (set_row, set_bit, set_member))
    order = np.lexsort((member, bit, row))
    row, bit, member = row[order], bit[order], member[order]
    height = np.zeros(rows, np.int64)
    np.maximum.at(height, row, bit + 1)
    first = np.concatenate([[0], np.cumsum(height)])
    bitmaps, _ = pack(first[row] + bit, member, int(first[-1]))
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), bitmaps)


# ---------------------------------------------------------------- words

class Grow:
    """An array that is appended to in place."""

    def __init__(self, kind):
        self.data, self.n = np.zeros(1024, kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.data):
            self.data = np.concatenate([self.data[:self.n], np.zeros(max(self.n, len(values)) + 1024, self.data.dtype)])
        self.data[self.n:self.n + len(values)] = values
        self.n += len(values)


class Words:
    """Tokens, groups and links of distinct words, remembered up to a bound of characters."""

    def __init__(self, a_json: str, b_model: bytes, characters: int = 8_000_000):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(a_json), SentencePieceProcessor(model_proto=b_model)
        self.a.encode_special_tokens = True
        self.a_bytes, self.b_bytes = byte_table(a_json), piece_table(self.b)
        self.a_size, self.b_size = (np.array([len(x) for x in table]) for table in (self.a_bytes, self.b_bytes))
        self.names = [[f"{i}{mark}" for i in range(max(len(self.a_bytes), len(self.b_bytes)))] for mark in (",", "|", ";")]
        mark = self.b.piece_to_id("▁")
        self.lone = [mark] if mark != self.b.unk_id() else [self.b.piece_to_id(f"<0x{x:02X}>") for x in "▁".encode()]
        self.characters = characters
        self.clear()

    def clear(self) -> None:
        self.index, self.groups, self.held = {}, [], 0
        self.sizes = [Grow(np.int64) for _ in range(4)]
        self.sound, self.starts, self.codes, self.times = Grow(bool), Grow(np.int64), Grow(np.int64), Grow(np.int64)
        self.starts.add(np.zeros(1, np.int64))

    def learn(self, words: set[str]) -> None:
        """Encode and align the words that are not known yet."""
        fresh = [w for w in words if w not in self.index]
        if self.held > self.characters:
            self.clear()
            fresh = list(words)
        if not fresh:
            return
        self.held += sum(map(len, fresh))
        base = len(self.index)
        self.index.update(zip(fresh, range(base, base + len(fresh))))
        coded = self.a.encode(fresh, is_pretokenized=True, add_special_tokens=False)
        owner, ids = np.array(coded.word_ids, np.int64), np.array(coded.ids, np.int64)
        cuts = np.searchsorted(owner, np.arange(len(fresh) + 1))
        b_ids = self.b.encode([w[1:] for w in fresh], num_threads=1)
        listed = ids.tolist()
        sound = np.zeros(len(fresh), bool)
        for i, word in enumerate(fresh):
            if word == " ":
                b_ids[i] = self.lone
            whole = word.encode("utf-8", "surrogatepass")
            a_joined = b"".join([self.a_bytes[t] for t in listed[cuts[i]:cuts[i + 1]]])
            sound[i] = a_joined == whole and b"".join([self.b_bytes[t] for t in b_ids[i]]) == whole
        kept = sound[owner]
        a_word, a_id = owner[kept], ids[kept]
        b_n = np.array([len(x) if ok else 0 for x, ok in zip(b_ids, sound)], np.int64)
        b_word = np.repeat(np.arange(len(fresh)), b_n)
        b_id = np.fromiter((t for x, ok in zip(b_ids, sound) if ok for t in x), np.int64, int(b_n.sum()))
        self._align(len(fresh), a_word, a_id, b_word, b_id)
        self.sound.add(sound)

    def _align(self, n: int, a_word: np.ndarray, a_id: np.ndarray, b_word: np.ndarray, b_id: np.ndarray) -> None:
        """Groups and links of ``n`` words whose bytes follow one another on one line."""
        a_end, b_end = np.cumsum(self.a_size[a_id]), np.cumsum(self.b_size[b_id])
        shared, ends = np.intersect1d(a_end, b_end, assume_unique=True), np.union1d(a_end, b_end)
        a_group, b_group = np.searchsorted(shared, a_end), np.searchsorted(shared, b_end)
        # A token ends its side of a group where the next one is of another group.
        a_last, b_last = (np.diff(g, append=-1) != 0 for g in (a_group, b_group))
        order = np.lexsort((np.repeat([0, 1], [len(a_id), len(b_id)]), np.concatenate([a_group, b_group])))
        mark = np.concatenate([np.where(a_last, 1, 0), np.where(b_last, 2, 0)])[order].tolist()
        names = [self.names[m][t] for m, t in zip(mark, np.concatenate([a_id, b_id])[order].tolist())]
        tokens = np.bincount(a_word, minlength=n) + np.bincount(b_word, minlength=n)
        at = np.concatenate([[0], np.cumsum(tokens)]).tolist()
        self.groups += ["".join(names[i:j])[:-1] for i, j in zip(at, at[1:])]
        # Between two neighbouring ends lies one token of each, and they overlap.
        a_at, b_at = np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)
        word, code = a_word[a_at], a_id[a_at] << B_BITS | b_id[b_at]
        for grown, counts in zip(self.sizes, (a_word, b_word, a_word[np.searchsorted(a_end, shared)], word)):
            grown.add(np.bincount(counts, minlength=n))
        order = np.lexsort((code, word))
        word, code = word[order], code[order]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(word) != 0) | (np.diff(code) != 0)])) if len(word) else np.zeros(0, np.int64)
        self.codes.add(code[new])
        self.times.add(np.diff(np.append(new, len(word))))
        self.starts.add(self.starts.data[self.starts.n - 1] + np.cumsum(np.bincount(word[new], minlength=n)))

    def links(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position in ``words``, pair code, links) of every distinct pair of every word."""
        first = self.starts.data[words]
        n = self.starts.data[words + 1] - first
        at = np.arange(int(n.sum())) + np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        return np.repeat(np.arange(len(words)), n), self.codes.data[at], self.times.data[at]


def byte_table(a_json: str) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    spec = json.loads(a_json)
    vocabulary = spec["model"]["vocab"]
    table = [b""] * (1 + max([*vocabulary.values(), *[t["id"] for t in spec["added_tokens"]]]))
    for token, i in vocabulary.items():
        table[i] = bytes(byte_of[c] for c in token)
    return table


def piece_table(model) -> list[bytes]:
    """The bytes of every piece: word marks as spaces, byte pieces as their byte."""
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]


def cuts_at_words(a_json: str, b_model: bytes) -> bool:
    """Whether ``units_of`` holds for the two: A splits texts by its own pattern and nothing else, no piece of B crosses words."""
    spec = json.loads(a_json)
    kind = spec["pre_tokenizer"] or {}
    plain = spec["normalizer"] is None and kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space")
    return bool(plain) and words_are_separate(b_model)


# ---------------------------------------------------------------- index and scores

_SCHEMA = ("chunk long, pair long, documents long, links long, bitmap binary, planes array<binary>, "
           "at int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string")
_ARROW = pa.schema([("chunk", pa.int64()), ("pair", pa.int64()), ("documents", pa.int64()), ("links", pa.int64()), ("bitmap", pa.binary()),
                    ("planes", pa.list_(pa.binary())), ("at", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
                    ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())])
_FACTS = [f.name for f in _ARROW][6:]


def _filled(columns: dict[str, object], n: int) -> list[pa.RecordBatch]:
    """Batches of at most 65,536 rows with the given columns; the others are null."""
    whole = pa.table([columns[f.name] if isinstance(columns.get(f.name), pa.Array) else pa.array(columns[f.name], f.type) if f.name in columns
                      else pa.nulls(n, f.type) for f in _ARROW], schema=_ARROW)
    return whole.to_batches(max_chunksize=65_536)


def _postings(chunk: int, key: np.ndarray, times: np.ndarray) -> list[pa.RecordBatch]:
    """The postings of a chunk, from (pair code and row in one number, links of one word). Bitmaps of words that link the same pair
    are OR-ed, their links added."""
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    new = np.flatnonzero(np.concatenate([[True], np.diff(key) != 0])) if len(key) else np.zeros(0, np.int64)
    key, times = key[new], np.add.reduceat(times, new) if len(new) else times
    code, member = key // CHUNK, key % CHUNK
    first = np.flatnonzero(np.concatenate([[True], np.diff(code) != 0])) if len(code) else new
    row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(code))))
    bitmaps, documents = pack(row, member, len(first))
    links = np.add.reduceat(times, first) if len(first) else times
    pairs = code[first]
    ids = (pairs >> B_BITS) << 32 | pairs & ((1 << B_BITS) - 1)
    return _filled({"chunk": np.full(len(first), chunk), "pair": ids, "documents": documents, "links": links, "bitmap": bitmaps,
                    "planes": planes_of(row, member, times - 1, len(first))}, len(first))


def index(docs: DataFrame, a_json: str, b_model: bytes) -> DataFrame:
    """One written table of two kinds of rows. With ``pair`` (id of A in the upper 32 bits, id of B in the lower): documents, links, bitmap and planes of
    the pair in a chunk of rows. Without: the facts of the row number ``at`` of the chunk."""
    apart = cuts_at_words(a_json, b_model)

    def run(batches):
        from pyspark import TaskContext

        words, chunk, facts, keys, times, held = Words(a_json, b_model), TaskContext.get().partitionId() << 32, [], [], [], 0

        def written():
            out = _postings(chunk, np.concatenate(keys), np.concatenate(times)) if keys else []
            columns = dict(zip(_FACTS, zip(*facts)))
            return out + _filled({"chunk": np.full(len(facts), chunk), **{n: list(v) for n, v in columns.items()}}, len(facts))

        for part, texts in texts_of(batches, rows=64):
            if held > ENTRIES or len(facts) + len(texts) > CHUNK:
                yield from written()
                chunk, facts, keys, times, held = chunk + 1, [], [], [], 0
            units = [units_of(t) if t and apart else [" " + t] if t else [] for t in texts]
            words.learn(set().union(*units))
            flat = np.fromiter((words.index[u] for own in units for u in own), np.int64)
            owner = np.repeat(np.arange(len(units)), [len(u) for u in units])
            broken = np.bincount(owner, ~words.sound.data[flat], len(units)) > 0
            flat, owner = flat[~broken[owner]], owner[~broken[owner]]
            n_a, n_b, n_groups, n_links = (np.bincount(owner, s.data[flat], len(units)).astype(np.int64).tolist() for s in words.sizes)
            # A document's words once each, with how often they occur.
            both, often = np.unique(owner << 32 | flat, return_counts=True)
            at, code, linked = words.links(both & 0xFFFFFFFF)
            keys.append(code * CHUNK + len(facts) + (both >> 32)[at])
            times.append(linked * often[at])
            held += len(at)
            for i, doc_id in enumerate(part.column(0).to_pylist()):
                text = ";".join([words.groups[words.index[u]] for u in units[i]]) if units[i] and not broken[i] else None
                facts.append((len(facts), doc_id, n_a[i], n_b[i], n_groups[i], n_links[i], sha256(text.encode()).hexdigest() if text is not None else ""))
        if facts:
            yield from written()

    return cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCHEMA))


def pair_counts(table: DataFrame) -> DataFrame:
    """(pair, a, b, documents, links) over the whole corpus. Chunks hold different rows, so the cardinalities of a pair's bitmaps add up to that of their OR."""
    sums = table.filter("pair is not null").groupBy("pair").agg(F.sum("documents").alias("documents"), F.sum("links").alias("links"))
    return sums.select("pair", F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b"), "documents", "links")


def _scores(_key, data):
    """The facts of a chunk's rows with the sums over their links of the pairs' counts, and how many links are their A id's best."""
    data = data.combine_chunks()
    is_fact = data["pair"].is_null()
    facts = data.filter(is_fact).sort_by("at")
    postings = data.filter(pa.compute.invert(is_fact)).combine_chunks()
    sums, best = np.zeros(CHUNK, np.int64), np.zeros(CHUNK, np.int64)
    if postings.num_rows:
        count, is_best = postings["count"].to_numpy(), postings["best"].to_numpy(zero_copy_only=False).astype(np.int64)
        planes = postings["planes"].chunk(0)
        height = np.diff(planes.offsets.to_numpy())
        owner = np.repeat(np.arange(len(height)), height)
        bit = np.arange(len(owner)) - np.repeat(np.cumsum(height) - height, height)
        for bitmaps, row, weight in ((postings["bitmap"].chunk(0), np.arange(len(count)), np.ones(len(count), np.int64)), (planes.flatten(), owner, 1 << bit)):
            at, member = unpack(bitmaps)
            np.add.at(sums, member, (weight * count[row])[at])
            np.add.at(best, member, (weight * is_best[row])[at])
    at = facts["at"].to_numpy()
    names = [n for n in _FACTS if n not in ("at", "groups_sha256")]
    return pa.table([*[facts[n] for n in names], pa.array(best[at]), pa.array(sums[at]), facts["groups_sha256"]], names=[*names, "n_best", "count_sum", "groups_sha256"])


def align(docs: DataFrame, a_json: str, b_model: bytes) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row for each input row.

    A encodes a space and the text, B the text, both without special tokens; the bytes of their tokens are those of a space and the text, or
    else the text (a null, an empty one, one with U+2581) has no tokens, zeros and an empty ``groups_sha256``. Byte offsets where both
    end a token cut the tokens into groups; a link is two tokens whose bytes overlap. The count of a pair of ids is the number of rows that
    hold it linked; repeated rows, and rows under one doc_id or none, count one by one. ``n_best`` counts links whose count
    is the highest of all pairs of their A id, ties included. Texts are read once, whole; an empty table gives an
    empty result; columns other than doc_id and text are not read.
    """
    written = index(docs, a_json, b_model)
    counts = cut(pair_counts(written).select("pair", "a", F.col("documents").alias("count")))
    # One row per id of A, so at most 2^20 of them.
    best = F.broadcast(counts.groupBy("a").agg(F.max("count").alias("most")))
    judged = counts.join(best, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    facts = written.filter("pair is null").select("chunk", "pair", "bitmap", "planes", *_FACTS)
    postings = written.filter("pair is not null").select("chunk", "pair", "bitmap", "planes").join(judged, "pair")
    rows = postings.unionByName(facts, allowMissingColumns=True)
    return rows.groupBy("chunk").applyInArrow(_scores, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
