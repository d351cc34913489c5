"""SentencePiece encoding and decoding by a weighted transducer.

The machine is the composition of a normaliser (one word mark in front, spaces to word marks), a trie of pieces with byte
fallback, and, for models built by merges, an acceptor of piece pairs: two pieces may stand side by side when
merging their joined characters gives back just these two. A merge that would cross a boundary depends on the two
pieces beside it alone, so the only path through the machine is what the merges make. For models with piece
probabilities every pair is allowed, and the shortest path in the tropical semiring decides.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import texts_of
from .tokencount import pre_tokens, words_are_separate

MARK = "▁"
_MERGES, _UNIGRAM = 2, 1


@dataclass
class Transducer:
    """Pieces, byte pieces and weights of a model; build with ``compile_model``."""

    pieces: list[str]
    weight: dict[str, float]
    number: dict[str, int]
    byte: list[int]
    merges: bool
    apart: bool
    trie: dict = field(default_factory=dict)
    longest: int = 1
    pairs: dict = field(default_factory=dict)
    built: dict = field(default_factory=dict)

    def normalise(self, text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def _history(self, piece: str) -> list[tuple[float, str, str]] | None:
        """How merging builds a piece alone: before each merge its weight, the first and the last symbol; at the end minus
        infinity and the piece twice. None if merging ends with something else."""
        if piece not in self.built:
            symbols, steps = list(piece), []
            while len(symbols) > 1:
                weights = [self.weight.get(x + y, -math.inf) for x, y in zip(symbols, symbols[1:])]
                best = max(weights)
                if best == -math.inf:
                    break
                steps.append((best, symbols[0], symbols[-1]))
                at = weights.index(best)
                symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
            self.built[piece] = [*steps, (-math.inf, piece, piece)] if len(symbols) == 1 else None
        return self.built[piece]

    def _beside(self, left: str, right: str) -> bool:
        """Whether merging the characters of both gives back the two: at no time may the merge across the boundary be the
        next one. Of equal weights, the leftmost goes first."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is not None:
            return known
        if len(self.pairs) > 500_000:
            self.pairs.clear()
        one, two, i, j, fits = self._history(left), self._history(right), 0, 0, True
        while True:
            (a, _, last), (b, first, _) = one[i], two[j]
            across = self.weight.get(last + first, -math.inf)
            if across > a and across >= b and across > -math.inf:
                fits = False
                break
            if a == b == -math.inf:
                break
            if a >= b:
                i += 1
            else:
                j += 1
        self.pairs[key] = fits
        return fits

    def arcs(self, text: str, start: int) -> list[str]:
        """Pieces that begin here, the longest last; a character without a piece of its own is an arc to its bytes."""
        node, out = self.trie, []
        for end in range(start, min(len(text), start + self.longest)):
            node = node.get(text[end])
            if node is None:
                break
            if "" in node:
                out.append(node[""])
        if not out or len(out[0]) > 1:
            out.insert(0, text[start])
        return [p for p in out if self._history(p)] if self.merges else out

    def _only_path(self, text: str) -> list[str]:
        """The one accepted path of a model of merges, depth first; states without a way on are remembered."""
        path, options, at, dead = [], [self.arcs(text, 0)], 0, set()
        while at < len(text):
            if options[-1]:
                piece = options[-1].pop()
                end = at + len(piece)
                if (end, piece) in dead or path and not self._beside(path[-1], piece):
                    continue
                path.append(piece)
                at = end
                if at < len(text):
                    options.append(self.arcs(text, at))
            else:
                options.pop()
                last = path.pop()
                dead.add((at, last))
                at -= len(last)
        return path

    def best_path(self, text: str) -> list[str]:
        """The pieces of the shortest path through the machine composed with the text.

        The pair acceptor of a model of merges leaves a single path, which is then the shortest; otherwise the smallest
        sum of negative log probabilities decides, the longer last piece among equals.
        """
        if not text:
            return []
        if self.merges:
            return self._only_path(text)
        cost, back = [0.0] + [math.inf] * len(text), [0] * (len(text) + 1)
        for at in range(len(text)):
            for piece in self.arcs(text, at):
                price = cost[at] - self.weight.get(piece, self.unknown)
                if price < cost[at + len(piece)]:
                    cost[at + len(piece)], back[at + len(piece)] = price, at
        out, at = [], len(text)
        while at:
            out.append(text[back[at]:at])
            at = back[at]
        return out[::-1]

    @cached_property
    def unknown(self) -> float:
        return min(self.weight.values(), default=0.0) - 10.0

    @cached_property
    def spelled(self) -> list[bytes]:
        """The bytes that each id stands for."""
        out = [p.replace(MARK, " ").encode("utf-8") for p in self.pieces]
        for value, i in enumerate(self.byte):
            out[i] = bytes([value])
        return out

    def ids_of(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            if p in self.number:
                out.append(self.number[p])
            else:
                out += [self.byte[b] for b in p.encode("utf-8", "surrogatepass")]
        return out

    def encode(self, text: str, memory: dict | None = None, bound: int = 500_000) -> list[int]:
        """Ids of a text. Where no piece crosses words, the machine runs on each pre-token, and ``memory`` keeps its answers."""
        memory = {} if memory is None else memory
        parts = pre_tokens(text) if self.apart else [text] if text else []
        out: list[int] = []
        for part in parts:
            got = memory.get(part)
            if got is None:
                if len(memory) > bound:
                    memory.clear()
                got = memory[part] = self.ids_of(self.best_path(MARK + part.replace(" ", MARK)))
            out += got
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of the ids: bytes joined, word marks turned to spaces, the first one dropped."""
        raw = b"".join(map(self.spelled.__getitem__, ids))
        text = raw.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def compile_model(model: bytes) -> Transducer:
    """The transducer of a sentencepiece model whose normaliser only marks words and which falls back to bytes."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    spec = proto.ModelProto.FromString(model)
    normal = spec.normalizer_spec
    if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.add_dummy_prefix or not spec.trainer_spec.byte_fallback:
        raise ValueError("needs a model with an identity normaliser, a dummy prefix and byte fallback")
    if spec.trainer_spec.model_type not in (_MERGES, _UNIGRAM):
        raise ValueError("needs a model of merges or of piece probabilities")
    plain = {i: p for i, p in enumerate(spec.pieces) if p.type == p.NORMAL}
    byte = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == p.BYTE}
    machine = Transducer([p.piece for p in spec.pieces], {p.piece: p.score for p in plain.values()}, {p.piece: i for i, p in plain.items()},
                         [byte[b] for b in range(256)], spec.trainer_spec.model_type == _MERGES, words_are_separate(model))
    for piece in machine.number:
        node = machine.trie
        for c in piece:
            node = node.setdefault(c, {})
        node[""] = piece
    machine.longest = max(map(len, machine.number), default=1)
    return machine


def encode_documents(docs: DataFrame, model: bytes, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys`` of every row with n_tokens, ids and ``restored``: whether decoding the ids gives the text back.

    Whole texts, one row for each input row. Null and empty texts have no ids and restore to the empty text. Word marks
    inside a text decode to spaces, so such a text is not restored. Repeated rows each come back; an empty table
    gives an empty result; other columns are not read.
    """
    def run(batches):
        machine, memory = compile_model(model), {}
        for part, texts in texts_of(batches, rows=64):
            ids = [machine.encode(t or "", memory) for t in texts]
            restored = [machine.decode(i) == (t or "") for i, t in zip(ids, texts)]
            yield pa.record_batch([*part.columns[:len(keys)], pa.array([len(i) for i in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())),
                                   pa.array(restored)], names=[*keys, "n_tokens", "ids", "restored"])

    rows = docs.select(*keys, "text")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(run, f"{kinds}, n_tokens long, ids array<int>, restored boolean")


def decode_documents(encoded: DataFrame, model: bytes, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys`` and the text of rows with ids; null ids give a null text."""
    def run(batches):
        machine = compile_model(model)
        for part, ids in texts_of(batches, "ids", rows=64):
            yield pa.record_batch([*part.columns[:len(keys)], pa.array([None if i is None else machine.decode(i) for i in ids], pa.string())], names=[*keys, "text"])

    rows = encoded.select(*keys, "ids")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "ids")
    return rows.mapInArrow(run, f"{kinds}, text string")
