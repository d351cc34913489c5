"""Language identification by hyperdimensional profiles of letter n-grams."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow_batch, texts_of

_GAP = 32


@dataclass(frozen=True)
class Profiles:
    """Letter vectors are random signs drawn from a hash of the letter, so every task and run draws the same."""

    dims: int = 1024
    seed: int = 3


class Encoder:
    """Bundles a document's letter trigrams; a trigram binds its letters' vectors, rotated by their place."""

    def __init__(self, how: Profiles):
        self.how = how
        self.is_letter = np.zeros(0x110000, np.int8) - 1
        self.signs: dict[int, np.ndarray] = {}

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct trigrams (packed code points) and their counts, over letters in lower case with one gap between words."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        known = self.is_letter[codes]
        if (known < 0).any():
            fresh = np.unique(codes[known < 0])
            self.is_letter[fresh] = [chr(c).isalpha() for c in fresh.tolist()]
            known = self.is_letter[codes]
        codes = np.concatenate([[_GAP], np.where(known == 1, codes, _GAP), [_GAP]]).astype(np.int64)
        codes = codes[np.concatenate([[True], (codes[1:] != _GAP) | (codes[:-1] != _GAP)])]
        if len(codes) < 3:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.unique((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:], return_counts=True)

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        mask = (1 << 21) - 1
        out = None
        for place, shift in enumerate((42, 21, 0)):
            letters, at = np.unique((grams >> shift) & mask, return_inverse=True)
            rows = np.array([np.roll(self._letter(int(c)), 2 - place) for c in letters], np.int8)[at]
            out = rows if out is None else out * rows
        return out.astype(np.float32)

    def _letter(self, code: int) -> np.ndarray:
        if code not in self.signs:
            bits = np.frombuffer(hashlib.shake_128(f"{self.how.seed}:{code}".encode()).digest(self.how.dims // 8), np.uint8)
            self.signs[code] = np.unpackbits(bits).astype(np.int8) * 2 - 1
        return self.signs[code]

    def bundles(self, counted: list[tuple[np.ndarray, np.ndarray]], rows: np.ndarray, n: int) -> np.ndarray:
        """(n, dims): sums of the documents' weighted gram vectors, document i added to row ``rows[i]``."""
        out = np.zeros((n, self.how.dims), np.float32)
        if not counted or not sum(len(g) for g, _ in counted):
            return out
        grams, column = np.unique(np.concatenate([g for g, _ in counted]), return_inverse=True)
        row = np.repeat(rows, [len(g) for g, _ in counted])
        weight = np.concatenate([w for _, w in counted]).astype(np.float32)
        order = np.argsort(column, kind="stable")
        row, column, weight = row[order], column[order], weight[order]
        for start in range(0, len(grams), 4096):
            a, b = np.searchsorted(column, [start, start + 4096])
            block = np.zeros((n, min(4096, len(grams) - start)), np.float32)
            np.add.at(block, (row[a:b], column[a:b] - start), weight[a:b])
            out += block @ self.vectors(grams[start:start + 4096])
        return out


def fit_profiles(labelled: DataFrame, how: Profiles = Profiles()) -> dict[str, np.ndarray]:
    """One unit vector per language from rows (lang, text): the bundle of its documents, each of length 1.

    All rows take part. Tasks send one vector per language, whose whole-number sums do not depend on the order; the driver holds
    one vector per language. Rows without letters or without a language add nothing; no rows give no profiles.
    """
    def run(batches):
        encoder, sums = Encoder(how), {}
        for part, texts in texts_of(batches):
            langs = part.column(0).to_pylist()
            counted = [encoder.counts(t or "") for t in texts]
            counted = [(g, w / np.sqrt(np.dot(w, w).astype(float))) if len(g) else (g, w) for g, w in counted]
            names = sorted(set(langs))
            place = {lang: i for i, lang in enumerate(names)}
            got = encoder.bundles(counted, np.array([place[lang] for lang in langs]), len(names))
            for lang, vector in zip(names, np.rint(got.astype(np.float64) * 1024).astype(np.int64)):
                sums[lang] = sums.get(lang, 0) + vector
        schema = pa.schema([("lang", pa.string()), ("vector", pa.list_(pa.int64()))])
        for lang, vector in sums.items():
            yield arrow_batch(schema, [lang], [vector])

    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text").mapInArrow(run, "lang string, vector array<long>")
    summed = rows.select("lang", F.posexplode("vector").alias("at", "v")).groupBy("lang", "at").agg(F.sum("v").alias("v"))
    profiles: dict[str, np.ndarray] = {}
    for r in summed.collect():
        profiles.setdefault(r["lang"], np.zeros(how.dims))[r["at"]] = r["v"]
    return {lang: v / np.linalg.norm(v) for lang, v in sorted(profiles.items()) if v.any()}


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], how: Profiles = Profiles(), keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys`` of every row with lang_pred and score: the language of largest cosine, ties to the first by name.

    ``score`` is that cosine, at least 0. Null texts, texts without letters, and an empty set of profiles give ``und`` and 0. Only
    the text is looked at. Repeated rows each come back; an empty table gives an empty result.
    """
    names, matrix = list(profiles), np.array(list(profiles.values())).reshape(len(profiles), how.dims).astype(np.float32)

    def run(batches):
        encoder = Encoder(how)
        for part, texts in texts_of(batches, rows=256):
            counted = [encoder.counts(t or "") for t in texts]
            got = encoder.bundles(counted, np.arange(len(texts)), len(texts))
            length = np.sqrt(np.einsum("ij,ij->i", got, got).astype(np.float64))
            if names:
                cosine = (got @ matrix.T).astype(np.float64) / np.maximum(length, 1e-9)[:, None]
                best = np.argmax(cosine, axis=1)
                top = np.clip(cosine[np.arange(len(texts)), best], 0.0, 1.0)
            none = [not len(g) or not names for g, _ in counted]
            lang = ["und" if none[i] else names[best[i]] for i in range(len(texts))]
            score = [0.0 if none[i] else float(top[i]) for i in range(len(texts))]
            yield pa.record_batch([*part.columns[:len(keys)], pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                  names=[*keys, "lang_pred", "score"])

    rows = docs.select(*keys, "text")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double")
