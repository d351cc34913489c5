"""Secret scans: base patterns, and spans that a linear-chain conditional random field tags."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import texts_of

# The base patterns and the least lengths of a match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "crf")
LEAST_VALUE = 8

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
VALUE = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, code points, by start and then kind."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


# ---------------------------------------------------------------- the field

#: Tags: outside, begin, inside.
O, B, I = 0, 1, 2


_KINDS_OF = str.maketrans({c: "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c if c in "\"'=:;,.!?()[]{}|/+-_@#" else "x"
                           for c in map(chr, range(128))})
_RUN = re.compile(r"(.)\1+")


def _shape(word: str) -> str:
    if word.isascii():
        return _RUN.sub(r"\1", word[:64].translate(_KINDS_OF))[:12]
    out = []
    for c in word[:64]:
        kind = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c if c in "\"'=:;,.!?()[]{}|/+-_@#" else "x"
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out[:12])


#: Words of letters and sentence marks only; nearly all words of a text are.
PLAIN = re.compile(rb"[A-Za-z\x80-\xff.,!?;]+")


def word_features(word: str) -> list[str]:
    """What a word shows of itself, whatever its neighbours."""
    core = VALUE.search(word)
    value = core.group() if core else ""
    if PLAIN.fullmatch(word.encode("utf-8", "surrogatepass")):
        # Without digits, turns and last signs: they are the same for all plain words and would only repeat the bias.
        out = ["plain", f"w{word.lower().rstrip('.,!?;')[:12]}", f"n{min(len(value) // 4, 10)}", f"s{_shape(word)[:4]}"]
        if value:
            out += [f"u{min(len(set(value)) // 4, 6)}", "mixed" if value != value.lower() and value != value.upper() else "one"]
        return out
    digits = sum(c.isdigit() for c in value)
    out = [f"n{min(len(value) // 4, 10)}", f"d{min(4, 5 * digits // max(1, len(value)))}", f"s{_shape(word)[:4]}"]
    if value:
        turns = sum(a.isdigit() != b.isdigit() for a, b in zip(value, value[1:]))
        out += [f"t{min(turns // 2, 5)}", f"u{min(len(set(value)) // 4, 6)}", "hex" if re.fullmatch("[0-9a-fA-F]+", value) else "nohex"]
        out.append("mixed" if any(c.isupper() for c in value) and any(c.islower() for c in value) else "one")
    else:
        letters = re.sub(r"[^a-z_]", "", word.lower())
        out.append(f"w{letters[:12]}" if len(letters) >= 2 else f"s{_shape(word)}")
    out.append(f"l{word[-1:]}" if word[-1:] in ":=\"'" else "l")
    return out


def shown(names: list[str]) -> list[str]:
    """Of a word's features, what its neighbours see: of a plain word that it is one, and which."""
    return names[:2] if names[0] == "plain" else names


def file_feature(words: list[str]) -> str:
    """How much of the text holds digits, in four steps."""
    share = sum(any(c.isdigit() for c in w) for w in words) / max(1, len(words))
    return f"f{sum(share >= s for s in (1e-9, 0.02, 0.2))}"


@dataclass
class Field:
    """Weights of a trained field: per feature and tag, and between tags; inside never follows outside."""

    weights: dict[str, np.ndarray]
    moves: np.ndarray

    def score(self, names: list[str]) -> np.ndarray:
        out = np.zeros(3)
        for name in names:
            w = self.weights.get(name)
            if w is not None:
                out += w
        return out

    def viterbi(self, emission: np.ndarray) -> np.ndarray:
        best, back = emission[0] + np.array([0.0, 0.0, -1e9]), []
        for e in emission[1:]:
            step = best[:, None] + self.moves
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + e
        tags = [int(best.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return np.array(tags[::-1])


def _sequence_features(words: list[str]) -> list[list[str]]:
    own = [word_features(w) for w in words]
    whole = file_feature(words)
    out = []
    for i in range(len(words)):
        names = ["bias", whole, *own[i]]
        names += [f"-{n}" for n in shown(own[i - 1])] if i else ["-start"]
        names += [f"+{n}" for n in shown(own[i + 1])] if i + 1 < len(words) else ["+end"]
        out.append(names)
    return out


def train(sequences: list[tuple[list[str], list[int]]], rounds: int = 60, least: int = 2, penalty: float = 0.02) -> Field | None:
    """Maximise the conditional likelihood of the tags by adaptive gradient steps; forward and backward sums run over all
    sequences at once. None if no sequence has a secret."""
    if not any(B in tags for _, tags in sequences):
        return None
    rows = [(_sequence_features(words), tags) for words, tags in sequences if words]
    seen = Counter(n for names, _ in rows for token in names for n in token)
    index = {n: i for i, n in enumerate(sorted(n for n, c in seen.items() if c >= least))}
    longest, count = max(len(t) for _, t in rows), len(rows)
    feature, token, tag_at = [], [], np.zeros((count, longest), np.int64)
    there = np.zeros((count, longest), bool)
    for r, (names, tags) in enumerate(rows):
        tag_at[r, :len(tags)], there[r, :len(tags)] = tags, True
        for t, own in enumerate(names):
            got = [index[n] for n in own if n in index]
            feature += got
            token += [r * longest + t] * len(got)
    feature, token = np.array(feature), np.array(token)
    gold = np.zeros((count * longest, 3))
    gold[np.arange(count * longest), tag_at.ravel()] = there.ravel()
    banned = np.zeros((3, 3))
    banned[O, I] = -1e9
    w, moves = np.zeros((len(index), 3)), np.zeros((3, 3))
    w_sum, m_sum = np.full_like(w, 1e-6), np.full_like(moves, 1e-6)
    gold_moves = np.zeros((3, 3))
    np.add.at(gold_moves, (tag_at[:, :-1][there[:, 1:]], tag_at[:, 1:][there[:, 1:]]), 1)

    def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)

    for _ in range(rounds):
        emission = np.stack([np.bincount(token, w[feature, k], count * longest) for k in range(3)], axis=1).reshape(count, longest, 3)
        step = moves + banned
        ahead = np.zeros((count, longest, 3))
        ahead[:, 0] = emission[:, 0] + np.array([0.0, 0.0, -1e9])
        for t in range(1, longest):
            ahead[:, t] = np.where(there[:, t, None], log_sum(ahead[:, t - 1, :, None] + step, 1) + emission[:, t], ahead[:, t - 1])
        total = log_sum(ahead[:, -1], 1)
        behind = np.zeros((count, longest, 3))
        pair = np.zeros((3, 3))
        for t in range(longest - 2, -1, -1):
            reach = step + (emission[:, t + 1] + behind[:, t + 1])[:, None, :]
            behind[:, t] = np.where(there[:, t + 1, None], log_sum(reach, 2), 0.0)
            joint = np.exp(ahead[:, t, :, None] + reach - total[:, None, None])
            pair += (joint * there[:, t + 1, None, None]).sum(axis=0)
        share = np.exp(ahead + behind - total[:, None, None]).reshape(-1, 3) * there.reshape(-1, 1)
        gap = gold - share
        grad = np.stack([np.bincount(feature, gap[token, k], len(index)) for k in range(3)], axis=1) - penalty * w
        move_grad = gold_moves - pair - penalty * moves
        w_sum, m_sum = w_sum + grad**2, m_sum + move_grad**2
        w, moves = w + 0.5 * grad / np.sqrt(w_sum), moves + 0.5 * move_grad / np.sqrt(m_sum)
    return Field({n: w[i] for n, i in index.items()}, moves + banned)


def tagged(text: str) -> tuple[list[str], list[int]]:
    """Words of a snippet with the tags that its base spans imply: the value of an assignment, an access key or a run of hex."""
    values = [m.span(2) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_VALUE]
    values += [(s, e) for s, e, kind in base_spans(text) if kind != "assign"]
    words, tags = [], []
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
        hit = next((s for s, e in values if s < m.end() and m.start() < e), None)
        before = tags[-1] if tags else O
        words.append(m.group())
        tags.append(O if hit is None else I if before and hit < m.start() else B)
    return words, tags


def snippets(docs: DataFrame, buckets: int, width: int = 400) -> DataFrame:
    """(hit, snippet): at most ``buckets`` snippets around a keyword and as many from elsewhere, one per hash bucket, the
    same whatever the file layout."""
    where = F.regexp_instr("text", F.lit(r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"))
    drawn = docs.select("text", F.xxhash64("text").alias("h"), where.alias("at")).filter("length(text) > 0")
    start = F.when(F.col("at") > 0, F.col("at") - width // 2).otherwise(F.pmod(F.col("h"), F.length("text")).cast("int"))
    cut_out = drawn.select((F.col("at") > 0).alias("hit"), "h", F.pmod(F.xxhash64("h"), F.lit(buckets)).alias("bucket"),
                           F.substring(F.col("text"), F.greatest(start, F.lit(1)), F.lit(width)).alias("snippet"))
    return cut_out.groupBy("hit", "bucket").agg(F.min(F.struct("h", "snippet")).alias("s")).select("hit", "s.snippet")


def fit_field(docs: DataFrame, sample: int = 300) -> Field | None:
    """A field trained on at most ``sample`` snippets with a keyword, ``sample`` without, and the former once more with the
    keyword hidden, so that the value and its surroundings carry weight too. None where the base patterns find nothing."""
    got = snippets(docs.select("text"), sample).collect()
    rows = sorted((r["hit"], r["snippet"]) for r in got)
    hidden = [re.sub(r"(?i)passwd|password|secret|token|api_?key", "value", s) for hit, s in rows if hit]
    sequences = [tagged(s) for _, s in rows]
    for (words, tags), masked in zip([q for q, (hit, _) in zip(sequences, rows) if hit], hidden):
        again = masked.split()
        if len(again) == len(words):
            sequences = [*sequences, (again, tags)]
    return train(sequences)


#: ASCII letters as their case, other bytes as they are.
_CASES = bytes.maketrans(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", b"a" * 26 + b"A" * 26)


class _Rows(dict):
    """Row of each word in the table of scores; words alike in all features share a row.

    What a plain ASCII word shows beside its letters follows from its pattern of cases and marks, which is looked at once.
    """

    def __init__(self, field: Field):
        super().__init__()
        self.field, self.row_of, self.patterns = field, {}, {}
        self.table, self.rows = np.zeros((1024, 10)), 0
        self.weighted = {n for w in field.weights for n in ((w, w[1:]) if w[0] in "-+" else (w,))}

    def _row(self, key: tuple, names: list[str], digits: bool) -> int:
        if self.rows == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        beside = [n for n in shown(names) if n in self.weighted]
        self.table[self.rows] = np.concatenate([self.field.score(names), *(self.field.score([side + n for n in beside]) for side in "-+"), [float(digits)]])
        self.row_of[key] = self.rows
        self.rows += 1
        return self.rows - 1

    def __missing__(self, word: bytes) -> int:
        pattern = word.translate(_CASES)
        if pattern.translate(None, b"aA.,!?;"):
            text = word.decode("utf-8", "replace")
            names, digits = word_features(text), any(c.isdigit() for c in text)
            key = (*[n for n in names if n in self.weighted], digits)
            row = self.row_of.get(key)
            row = self[word] = self._row(key, names, digits) if row is None else row
            return row
        told = self.patterns.get(pattern)
        if told is None:
            core = VALUE.search(word.decode())
            told = self.patterns[pattern] = (tuple(n for n in word_features(word.decode()) if n[0] not in "wu" and n in self.weighted), core.span() if core else (0, 0))
        rest, (start, end) = told
        name = "w" + word.lower().rstrip(b".,!?;")[:12].decode()
        distinct = min(len(set(word[start:end])) // 4, 6)
        key = (rest, distinct, name if name in self.weighted else None)
        row = self.row_of.get(key)
        row = self[word] = self._row(key, word_features(word.decode()), False) if row is None else row
        return row


class Scanner:
    """Tags whole texts. Words are looked up once; a text is decoded only where some path could beat all-outside. What is
    remembered starts anew beyond ``bound`` words or rows."""

    def __init__(self, field: Field | None, bound: int = 400_000):
        self.field, self.bound = field, bound
        if field is not None:
            self.rows = _Rows(field)
            self.whole = [field.score(["bias", f"f{i}"]) for i in range(4)]
            self.first, self.last = field.score(["-start"]), field.score(["+end"])

    def tags(self, words: list[bytes]) -> np.ndarray | None:
        """Best tags, or None if all are outside."""
        if len(self.rows) > self.bound or self.rows.rows > self.bound or len(self.rows.patterns) > self.bound:
            self.rows = _Rows(self.field)
        ids = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        got = self.rows.table[ids]
        share = got[:, 9].mean()
        emission = got[:, :3] + self.whole[sum(share >= s for s in (1e-9, 0.02, 0.2))]
        emission[1:] += got[:-1, 3:6]
        emission[:-1] += got[1:, 6:9]
        emission[0] += self.first
        emission[-1] += self.last
        moves = self.field.moves
        # No move gains more than this over staying outside, so a stretch of other tags gains at most what its
        # beginning does plus whatever may help inside it.
        most = max(0.0, float(moves.max()) - float(moves[O, O]))
        begin = emission[:, B] - emission[:, O] + 2 * most
        inside = np.maximum(emission[:, I] - emission[:, O] + most, 0.0)
        if (begin + inside.sum() - inside).max() <= 0:
            return None
        tags = self.field.viterbi(emission)
        return tags if tags.any() else None


def scan_text(text: str, scanner: Scanner) -> tuple[list, list]:
    """(base spans, spans the field adds); added ones touch no base span."""
    base = base_spans(text)
    if scanner.field is None:
        return base, []
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    tags = scanner.tags(words) if words else None
    if tags is None:
        return base, []
    added = []
    for number, m in enumerate(WORD.finditer(raw)):
        if not tags[number]:
            continue
        first = len(raw[:m.start()].decode("utf-8", "surrogatepass"))
        for v in VALUE.finditer(m.group().decode("utf-8", "surrogatepass")):
            start, end = first + v.start(), first + v.end()
            if not any(s < end and start < e for s, e, _ in base):
                added.append((start, end, "crf"))
    return base, added


def scan(docs: DataFrame, field: Field | None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans), one row for each input row, whole texts.

    Null and empty texts have no spans and the digest of the empty list. Repeated rows each come back; an empty table gives an
    empty result; columns other than doc_id and text are not read.
    """
    def run(batches):
        import hashlib

        scanner = Scanner(field)
        for part, texts in texts_of(batches):
            out = {c: [] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
            for text in texts:
                base, added = scan_text(text or "", scanner)
                kinds = Counter(k for _, _, k in base)
                for kind in KINDS[:3]:
                    out[f"n_{kind}"].append(kinds[kind])
                out["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
                out["spans"].append(written([*base, *added]))
            yield pa.record_batch([part.column(0), *[pa.array(v, pa.int64()) for v in list(out.values())[:3]],
                                   *[pa.array(v, pa.string()) for v in list(out.values())[3:]]], names=["doc_id", *out])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def find_secrets(docs: DataFrame, sample: int = 300) -> DataFrame:
    """Train on ``docs`` and scan them."""
    return scan(docs, fit_field(docs, sample))


def masked(text: str | None, scanner: Scanner, mask: str = "[SECRET]") -> str | None:
    """The text with every span replaced; overlapping spans are one."""
    if not text:
        return text
    base, added = scan_text(text, scanner)
    out, at = [], 0
    for start, end, _ in sorted([*base, *added]):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, field: Field | None, size_column: str | None = "n_chars") -> DataFrame:
    """The rows of ``docs`` with secrets masked in ``text``, and ``size_column``, if there, set to the new length."""
    def run(batches):
        scanner = Scanner(field)
        for part, texts in texts_of(batches):
            at = part.schema.get_field_index("text")
            yield part.set_column(at, part.schema.field(at), pa.array([masked(t, scanner) for t in texts], part.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn(size_column, F.length("text").cast(docs.schema[size_column].dataType)) if size_column in docs.columns else out
