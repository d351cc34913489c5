"""Token counts: pieces are counted once per distinct pre-token and summed by per-document frequencies."""

from __future__ import annotations

import re
from collections import Counter
from operator import mul

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import texts_of

_RUN = re.compile(" *[^ ]+| +")


def words_are_separate(model: bytes) -> bool:
    """Whether texts may be cut before each run of spaces: the normaliser only turns spaces into word marks, the first
    word gets one too, and no piece holds a mark after another character."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    spec = proto.ModelProto.FromString(model)
    plain = not spec.normalizer_spec.precompiled_charsmap and not spec.normalizer_spec.remove_extra_whitespaces
    marked = spec.normalizer_spec.add_dummy_prefix and spec.normalizer_spec.escape_whitespaces and not spec.trainer_spec.treat_whitespace_as_suffix
    return bool(plain and marked and not any(re.search("[^▁]▁", p.piece) for p in spec.pieces))


def pre_tokens(text: str) -> list[str]:
    """The stretches of a text that no piece crosses, each without the word mark it begins with."""
    text = text.replace("▁", " ")
    if not text:
        return []
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [m[1:] for m in _RUN.findall(" " + text)]


def count_tokens(docs: DataFrame, model: bytes, limit: int = 4096, memory: int = 500_000) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row for each input row, whole texts.

    Counts are those of the sentencepiece library without added tokens. A task counts the pieces of each distinct
    pre-token once, in a table of at most ``memory`` pre-tokens that starts anew when full, joins that to each document's
    pre-token frequencies and sums; no ids are kept and nothing is shuffled. Null texts are empty and have no tokens; repeated
    rows each come back; an empty table gives an empty result; columns other than doc_id and text are not read. For a
    model whose pieces can cross words, a whole text is its own pre-token.
    """
    apart = words_are_separate(model)

    def run(batches):
        from sentencepiece import SentencePieceProcessor

        pieces = SentencePieceProcessor(model_proto=model)
        # A lone mark, the empty string here, is a piece or its three bytes.
        lone = {"": 1 if pieces.piece_to_id("▁") != pieces.unk_id() else 3}
        counted = dict(lone)
        for part, texts in texts_of(batches, rows=256):
            frequencies = [Counter(pre_tokens(t or "") if apart else [t] if t else []) for t in texts]
            fresh = list(set().union(*frequencies).difference(counted))
            if len(counted) + len(fresh) > memory:
                counted = dict(lone)
                fresh = list(set().union(*frequencies).difference(counted))
            if fresh:
                counted.update(zip(fresh, map(len, pieces.encode(fresh, num_threads=1))))
            sums = [sum(map(mul, map(counted.__getitem__, own), own.values())) for own in frequencies]
            sizes = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.record_batch([part.column(0), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
