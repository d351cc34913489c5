"""Token alignment against the two libraries and direct counting."""

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from conftest import SF
from gleanery.llm import alignment
from gleanery.llm.queries import model_bytes, tokenizer_json

TEXTS = ["Plain words, it's <|endoftext|> and </s> <s>.", "  two  spaces at  start", "end ", " ", "  ", "\n", "a\n b\n \n c \t d", "tab\tand\x0bmore \x1c x\x1f y", "ünïcode — 漢字 テスト 😀😀 é",
         "a▁b", "▁", "x" * 5000, "12345 67 8,9 10.11", "don't we'll 'tis 's", "　wide 　space  x", "\x00 nul \x7f", "a\r\nb", "\xa0nb \xa0 nb", "word " * 3000, None, "", "<unk> <0x41>", "᠎ x ​ y"]


def brute(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_str(tokenizer_json()), SentencePieceProcessor(model_proto=model_bytes())
    a.encode_special_tokens = True
    a_bytes, b_bytes = alignment.byte_table(tokenizer_json()), alignment.piece_table(b)
    found, counts = [], Counter()
    for doc_id, text in rows:
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes[t] for t in x) != whole or b"".join(b_bytes[t] for t in y) != whole:
            found.append((doc_id, [], [], [], []))
            continue
        i = j = at_a = at_b = 0
        groups, links, own = [], [], ([], [])
        at_a, at_b = len(a_bytes[x[0]]), len(b_bytes[y[0]])
        own[0].append(x[0]), own[1].append(y[0])
        while True:
            links.append((x[i], y[j]))
            if at_a == at_b:
                groups.append(f"{','.join(map(str, own[0]))}|{','.join(map(str, own[1]))}")
                own = ([], [])
                if i + 1 == len(x):
                    break
            step_a, step_b = at_a <= at_b, at_b <= at_a
            if step_a:
                i += 1
                at_a += len(a_bytes[x[i]])
                own[0].append(x[i])
            if step_b:
                j += 1
                at_b += len(b_bytes[y[j]])
                own[1].append(y[j])
        assert j + 1 == len(y)
        found.append((doc_id, x, y, groups, links))
        counts.update(set(links))
    best = {}
    for (p, _), n in counts.items():
        best[p] = max(best.get(p, 0), n)
    return sorted((str(d), len(x), len(y), len(g), len(k), sum(counts[p] == best[p[0]] for p in k), sum(counts[p] for p in k),
                   sha256(";".join(g).encode()).hexdigest() if x else "") for d, x, y, g, k in found)


def got(frame):
    return sorted((str(r["doc_id"]), *r[1:]) for r in alignment.align(frame, tokenizer_json(), model_bytes()).collect())


def test_odd_texts_nulls_and_repeats(spark):
    rows = [*enumerate(TEXTS), (None, "no id here"), (None, "no id here"), (0, "one id twice"), (0, TEXTS[0])]
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, pair long, chunk string").repartition(3)
    assert got(frame) == brute(rows)
    assert got(frame.filter("false")) == []


def test_words_of_any_characters(spark):
    draw = random.Random(5)
    letters = list("ab '\t\n\r.,1é漢😀") + [" "] * 8 + ["\x1c", "\x85", "\xa0", " ", "　", "﻿", "▁"]
    rows = [(i, "".join(draw.choices(letters, k=draw.randint(1, 60)))) for i in range(1500)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


def test_smallest_documents(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert got(docs) == brute(rows)


def test_corpus_counts(spark):
    rows = [(i, f"same words {i % 3} here here") for i in range(30)]
    table = alignment.index(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), tokenizer_json(), model_bytes())
    counts = alignment.pair_counts(table).collect()
    assert max(r["documents"] for r in counts) == 30
    assert [r["links"] for r in counts if r["links"] != r["documents"]] == [60]


@pytest.mark.parametrize("share", [0.0005, 0.05, 0.3, 0.9])
def test_bitmaps_come_back(share):
    draw = np.random.default_rng(4)
    hit = draw.random((40, alignment.CHUNK)) < share
    hit[7] = False
    row, member = np.nonzero(hit)
    bitmaps, counts = alignment.pack(row, member, 40)
    assert counts.tolist() == hit.sum(axis=1).tolist()
    back = np.zeros_like(hit)
    back[alignment.unpack(bitmaps)] = True
    assert (back == hit).all()
    more = draw.integers(0, 9, len(row))
    planes, total = alignment.planes_of(row, member, more, 40), np.zeros(hit.shape, np.int64)
    for i, own in enumerate(planes.to_pylist()):
        for k, plane in enumerate(own):
            total[i, alignment.unpack(pa.array([plane]))[1]] += 1 << k
    assert (total[row, member] == more).all() and total.sum() == more.sum()
