"""Operator 9: SentencePiece encoding and decoding by unigram Viterbi over a double-array trie.

The vocabulary file is read, never trained: its pieces, types and order come from the model's own
protocol buffer. A piece's log score is either the score in the file or, for files that carry merge
ranks instead of log probabilities, a Zipf log probability of its rank (``scores="zipf"``).

A text is cut where no piece can reach across (before a run of white-space markers, around line
breaks), each distinct stretch of a slice of texts is segmented once, and all short stretches are
segmented together: one numpy step extends every stretch by one position of the lattice.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm.common import SLICE_BYTES, ship, slices, table, text_of

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values: piece types of the model format
UNKNOWN_PENALTY = 10.0  # fixed value: below the least score of a normal piece
LONG = 48  # longer stretches are segmented one by one
ROWS = 8192  # short stretches segmented together
MEMO = 150_000  # stretches remembered by a worker process between slices


def _fields(buf: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of one protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = buf[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(buf):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, buf[at : at + n]
            at += n


def read_vocabulary(path: str = VOCABULARY, scores: str = "zipf") -> list[tuple[str, float, int]]:
    """(piece, log score, type) by id."""
    with open(path, "rb") as f:
        model = f.read()
    pieces = []
    for number, value in _fields(model):
        if number == 1:
            parts = dict(_fields(value))
            score = np.frombuffer(parts[2], np.float32)[0] if 2 in parts else 0.0
            pieces.append((parts[1].decode(), float(score), int(parts.get(3, NORMAL))))
    if scores == "zipf":
        ranked = [i for i, p in enumerate(pieces) if p[2] == NORMAL]
        total = math.log(sum(1 / r for r in range(1, len(ranked) + 1)))
        for r, i in enumerate(ranked, 1):
            pieces[i] = (pieces[i][0], -math.log(r) - total, NORMAL)
    return pieces


class PieceModel:
    """Double-array trie of the pieces' characters, their log scores, and both directions of coding."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        self.pieces = pieces
        kind = [t for _, _, t in pieces]
        known = {p: i for i, (p, _, t) in enumerate(pieces) if t in (NORMAL, USER)}
        self.score = np.array([s for _, s, _ in pieces], np.float64)
        self.unknown_score = min((pieces[i][1] for i in known.values()), default=0.0) - UNKNOWN_PENALTY
        self.unknown_id = kind.index(UNKNOWN)
        bytes_ = {int(p[1:-1], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.byte_id = [bytes_[b] for b in range(256)] if len(bytes_) == 256 else None
        self.longest = max(map(len, known), default=1)
        self._cuts(known)
        self._build(known)
        self.raw = [bytes([int(p[1:-1], 16)]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else p.replace(MARK, " ").encode() for p, _, t in pieces]
        self.is_byte = np.array([t == BYTE for t in kind])

    def _cuts(self, known: dict[str, int]) -> None:
        """The pattern of stretches that pieces never reach across."""
        crosses = any(MARK in p.lstrip(MARK) for p in known)
        breaks = not any("\n" in p for p in known)
        if crosses:
            self.stretch = re.compile(r"[^\n]+|\n" if breaks else r"(?s).+")
        else:
            self.stretch = re.compile(r" *[^ \n]+| +|\n" if breaks else r"(?s) *[^ ]+| +")

    def _build(self, known: dict[str, int]) -> None:
        letters = Counter(c for p in known for c in p)
        self.code = {c: k for k, (c, _) in enumerate(letters.most_common(), 1)}
        self.code_of = np.zeros(0x110000, np.int32)
        for c, k in self.code.items():
            self.code_of[ord(c)] = k
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for p, i in known.items():
            node = 0
            for c in p:
                k = self.code[c]
                if k not in children[node]:
                    children[node][k] = len(children)
                    children.append({})
                    value.append(-1)
                node = children[node][k]
            value[node] = i
        size = len(children) + 2 * len(self.code) + 2
        base, check, leaf = [0] * size, [-1] * size, [-1] * size
        check[0] = -2
        look, todo = 1, [(0, 0)]  # slots before ``look`` are nearly all taken
        while todo:
            node, slot = todo.pop()
            kids = sorted(children[node].items())
            if not kids:
                continue
            first, last = kids[0][0], kids[-1][0]
            at, taken, seen = max(look, first + 1) if slot else first, 0, None
            while True:
                if at - first + last >= size:
                    more = at - first + last + size // 2 - size + 1
                    base += [0] * more
                    check += [-1] * more
                    leaf += [-1] * more
                    size += more
                if check[at] != -1:
                    taken += 1
                else:
                    seen = at if seen is None else seen
                    if all(check[at - first + k] == -1 for k, _ in kids):
                        break
                at += 1
            if seen is not None and taken >= 0.9 * (at - max(look, first + 1) + 1):
                look = max(look, at)
            base[slot] = at - first
            for k, child in kids:
                check[at - first + k] = slot
                leaf[at - first + k] = value[child]
                todo.append((child, at - first + k))
        pad = len(self.code) + 1
        self.base = np.array(base, np.int32)
        self.check = np.array(check + [-1] * pad, np.int32)
        self.leaf = np.array(leaf + [-1] * pad, np.int32)

    # encoding

    def viterbi_one(self, s: str) -> bytes:
        """Best segmentation of one stretch, position by position, as little-endian 32-bit ids."""
        n = len(s)
        codes = [self.code.get(c, 0) for c in s]
        best, back, piece = [-math.inf] * (n + 1), [0] * (n + 1), [self.unknown_id] * (n + 1)
        best[0] = 0.0
        base, check, leaf, score = self.base, self.check, self.leaf, self.score
        for p in range(n):
            slot, single = 0, False
            for e in range(p, n):
                k = codes[e]
                to = base[slot] + k
                if not k or check[to] != slot:
                    break
                slot = to
                if (i := leaf[slot]) >= 0:
                    single |= e == p
                    if (x := best[p] + score[i]) > best[e + 1]:
                        best[e + 1], back[e + 1], piece[e + 1] = x, p, int(i)
            if not single and (x := best[p] + self.unknown_score) > best[p + 1]:
                best[p + 1], back[p + 1], piece[p + 1] = x, p, self.unknown_id
        out, e = [], n
        while e:
            out.append((piece[e], s[back[e] : e]))
            e = back[e]
        return np.array(self._spell(out[::-1]), np.int32).tobytes()

    def _spell(self, found: list[tuple[int, str]]) -> list[int]:
        """Unknown characters become the pieces of their UTF-8 bytes."""
        out: list[int] = []
        for i, part in found:
            if i == self.unknown_id and self.byte_id:
                out += [self.byte_id[b] for b in part.replace(MARK, " ").encode("utf-8", "surrogatepass")]
            elif i != self.unknown_id or not out or out[-1] != i:
                out.append(i)
        return out

    def viterbi_many(self, stretches: list[str]) -> list[bytes]:
        """Best segmentations of stretches of about one length; each numpy step serves all of them.
        Row ``e`` of the tables holds the lattice position ``e`` of every stretch."""
        rows, width = len(stretches), max(map(len, stretches))
        size = np.fromiter(map(len, stretches), np.int64, rows)
        codes = np.zeros((rows, width), np.int32)
        points = np.frombuffer("".join(stretches).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes[np.arange(width) < size[:, None]] = self.code_of.take(points)
        codes = np.ascontiguousarray(codes.T)
        best = np.full((width + 1, rows), -np.inf)
        back = np.zeros((width + 1, rows), np.int32)
        piece = np.full((width + 1, rows), self.unknown_id, np.int32)
        best[0] = 0
        for p in range(width):
            row, slot = None, None
            for e in range(p, min(p + self.longest, width)):
                to = codes[e] if row is None else self.base.take(slot) + codes[e].take(row)
                if row is None:
                    good = np.flatnonzero((self.check.take(to) == 0) & (to > 0))
                    row, slot = good, to.take(good)
                else:
                    good = np.flatnonzero(self.check.take(to) == slot)
                    row, slot = row.take(good), to.take(good)
                if not len(row):
                    break
                i = self.leaf.take(slot)
                x = best[p].take(row) + self.score.take(i)
                new = np.flatnonzero((i >= 0) & (x > best[e + 1].take(row)))
                r = row.take(new)
                best[e + 1][r], back[e + 1][r], piece[e + 1][r] = x.take(new), p, i.take(new)
                if e == p:
                    single = np.zeros(rows, bool)
                    single[row[i >= 0]] = True
            else:
                e = p
            if not len(row) and e == p:
                single = np.zeros(rows, bool)
            r = np.flatnonzero(~single & (best[p] + self.unknown_score > best[p + 1]))
            best[p + 1][r], back[p + 1][r], piece[p + 1][r] = best[p][r] + self.unknown_score, p, self.unknown_id
        at, lane, steps = size.copy(), np.arange(rows), []
        while at.any():  # from the ends back; a finished stretch stays at 0
            steps.append(np.where(at > 0, piece[at, lane], -1))
            at = np.where(at > 0, back[at, lane], 0)
        found = np.stack(steps[::-1], axis=1)
        keep = found >= 0
        blob = found[keep].astype(np.int32).tobytes()
        ends = (4 * np.cumsum(keep.sum(axis=1))).tolist()
        odd = (found == self.unknown_id).any(axis=1).tolist()
        return [self.viterbi_one(s) if o else blob[x:y] for s, o, x, y in zip(stretches, odd, [0, *ends[:-1]], ends)]

    def split(self, text: str) -> list[str]:
        """Stretches of the text; a leading space is put before a text that isn't empty."""
        return self.stretch.findall(" " + text.replace(MARK, " ")) if text else []

    def encode_batch(self, texts: list[str], memo: dict[str, bytes] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and row offsets into them."""
        memo = {} if memo is None else memo
        cut = [self.split(t) for t in texts]
        words = set().union(*cut) if cut else set()
        if len(memo) + len(words) > MEMO + len(words & memo.keys()):
            memo.clear()
        new = words - memo.keys()
        short = sorted((w for w in new if len(w) <= LONG), key=len)
        for at in range(0, len(short), ROWS):
            part = short[at : at + ROWS]
            memo.update(zip(part, self.viterbi_many([w.replace(" ", MARK) for w in part])))
        memo.update((w, self.viterbi_one(w.replace(" ", MARK))) for w in new if len(w) > LONG)
        coded = [b"".join(map(memo.__getitem__, c)) for c in cut]
        rows = np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])]).astype(np.int64)
        return np.frombuffer(b"".join(coded), np.int32), rows

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    # decoding

    def decode(self, ids) -> str:
        """Markers become spaces, byte pieces are joined to characters, the leading space goes."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        out = raw.decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") else out


def encode_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, scores: str = "zipf") -> DataFrame:
    """One row per row of ``docs``: key, ids, n_pieces, n_byte_pieces, n_chars, round_trip (decoding
    the ids gives the text, with U+2581 read as the space it stands for).

    Null and empty texts have no ids. Of segmentations with equal scores, the one whose last piece
    starts first is taken. Repeated rows are coded alike; other columns are not looked at.
    """
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(PieceModel(read_vocabulary(vocabulary, scores)))
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches):
        m, memo = model.value, {}
        for b in slices(batches, "_text", SLICE_BYTES // 4):
            texts = b.column(1).to_pylist()
            ids, rows = m.encode_batch(texts, memo)
            flat = ids.tolist()
            same = [m.decode(flat[a:z]) == t.replace(MARK, " ") for t, a, z in zip(texts, rows[:-1].tolist(), rows[1:].tolist())]
            byte = np.concatenate([[0], np.cumsum(m.is_byte[ids])])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(ids, pa.int32())),
                    pa.array(np.diff(rows), pa.int64()),
                    pa.array(byte[rows[1:]] - byte[rows[:-1]], pa.int64()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array(same, pa.bool_()),
                ],
                names=[key, "ids", "n_pieces", "n_byte_pieces", "n_chars", "round_trip"],
            )

    narrow = docs.select(F.col(key), text_of(text).alias("_text"))
    return narrow.mapInArrow(run, f"`{key}` {key_type}, ids array<int>, n_pieces long, n_byte_pieces long, n_chars long, round_trip boolean")


def decode_documents(coded: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per row of ``coded``: key, text. Null ids decode to the empty text."""
    ship(coded.sparkSession)
    model = coded.sparkSession.sparkContext.broadcast(PieceModel(read_vocabulary(vocabulary)))
    key_type = coded.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.value.decode(x or ()) for x in b.column(1).to_pylist()], pa.string())], names=[key, "text"])

    return coded.select(F.col(key), F.col(ids).alias("_ids")).mapInArrow(run, f"`{key}` {key_type}, text string")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
