"""SentencePiece encoding and decoding (operator 5): unigram Viterbi over a double-array trie.

The pieces and log scores come from a SentencePiece model file. A text gets a leading blank,
blanks become the marker U+2581, and the segmentation with the greatest total score is found
by dynamic programming over the trie's matches (ties: the longest last piece). A character
that no piece covers costs less than any piece and is written as its UTF-8 bytes' pieces.

No piece has a marker after another character, so the best segmentation of a text is that of
its marker-led units one after another; units recur, and the program runs over all new units
of a batch at once, column by column. A model with other pieces is run on whole texts.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashlens.llm.common import python_tasks

MARK = "▁"
CACHE_UNITS = 300_000
LONG_UNIT = 64  # bytes; longer units are segmented one by one
UNKNOWN_PENALTY = 10.0
UNITS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class DoubleArray:
    """A trie in two arrays: the child of ``s`` under byte ``c`` is ``t = base[s] + c`` if
    ``check[t] == s``. ``value[t]`` is the id of the key that ends at ``t``, or -1."""

    def __init__(self, keys: list[bytes], ids: list[int]):
        order = sorted(range(len(keys)), key=lambda i: keys[i])
        keys, ids = [keys[i] for i in order], [ids[i] for i in order]
        size = 1 << 12
        self.base, self.check = [0] * size, [-1] * size
        self.value = [-1] * size
        self.check[0] = 0
        free, last = 257, 0
        queue = [(0, 0, len(keys), 0)]  # state, range of keys, depth
        at = 0
        while at < len(queue):
            state, low, high, depth = queue[at]
            at += 1
            children: list[tuple[int, int, int]] = []
            for i in range(low, high):
                if len(keys[i]) == depth:
                    self.value[state] = ids[i]
                elif children and children[-1][0] == keys[i][depth]:
                    children[-1] = (children[-1][0], children[-1][1], i + 1)
                else:
                    children.append((keys[i][depth], i, i + 1))
            if not children:
                continue
            while free < len(self.check) and self.check[free] >= 0:
                free += 1
            # The first few free cells that take the least child, else the end of the arrays.
            first, cell, b = children[0][0], free, 0
            for _ in range(32):
                while cell < len(self.check) and self.check[cell] >= 0:
                    cell += 1
                if cell - first >= 1 and cell + 256 < len(self.check) and all(
                        self.check[cell - first + c] < 0 for c, _, _ in children):
                    b = cell - first
                    break
                cell += 1
            else:
                free = min(cell, last + 1)  # leave the holes that fit badly
                b = last + 1
            if b + 256 >= len(self.check):
                grow = len(self.check)
                self.base += [0] * grow
                self.check += [-1] * grow
                self.value += [-1] * grow
            last = max(last, b + children[-1][0])
            self.base[state] = b
            for c, i, j in children:
                self.check[b + c] = state
                queue.append((b + c, i, j, depth + 1))
        self.arrays = tuple(np.array(x, np.int32) for x in (self.base, self.check, self.value))


class PieceModel:
    """Pieces of a SentencePiece file, as plain tables that travel to the tasks."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.scores = np.array([sp.get_score(i) for i in range(n)])
        self.byte_ids = [0] * 256
        self.decoded: list[bytes] = []
        normal: list[int] = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.decoded.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.decoded.append(b"")
            else:
                normal.append(i)
                self.decoded.append(piece.replace(MARK, " ").encode())
        pieces = [sp.id_to_piece(i) for i in normal]
        self.by_units = all(MARK not in p.lstrip(MARK) for p in pieces)
        self.base, self.check, self.value = DoubleArray([p.encode() for p in pieces], normal).arrays
        self.unknown = float(min(self.scores[normal], default=0.0)) - UNKNOWN_PENALTY


def char_starts(raw: bytes) -> list[int]:
    return [i for i, b in enumerate(raw) if b & 0xC0 != 0x80] + [len(raw)]


class PieceCodec:
    """Encoder and decoder of one model in one worker."""

    def __init__(self, model: PieceModel):
        self.m = model
        self.cache: dict[str, bytes] = {}
        self.lists: tuple | None = None

    def segment_one(self, raw: bytes) -> list[int]:
        """Viterbi over one UTF-8 string, byte by byte."""
        m = self.m
        if self.lists is None:
            self.lists = m.base.tolist(), m.check.tolist(), m.value.tolist(), m.scores.tolist()
        base, check, value, scores = self.lists
        n, size = len(raw), len(check)
        best: list[float] = [float("-inf")] * (n + 1)
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        best[0] = 0.0
        starts = char_starts(raw)
        for s, after in zip(starts, starts[1:]):
            here, state, covered = best[s], 0, False
            for e in range(s, n):
                t = base[state] + raw[e]
                if t >= size or check[t] != state or t == 0:
                    break
                state = t
                if value[t] >= 0:
                    covered = covered or e + 1 == after
                    total = here + scores[value[t]]
                    if total > best[e + 1]:
                        best[e + 1], back[e + 1] = total, (s, value[t])
            if not covered and here + m.unknown > best[after]:
                best[after], back[after] = here + m.unknown, (s, -1)
        out: list[int] = []
        e = n
        while e > 0:
            s, piece = back[e]
            out.extend([piece] if piece >= 0 else [m.byte_ids[b] for b in reversed(raw[s:e])])
            e = s
        return out[::-1]

    def segment_many(self, units: list[bytes]) -> list[bytes]:
        """The same program over many short units at once: arrays run over units, loops over
        byte positions."""
        m = self.m
        n = len(units)
        length = np.array([len(u) for u in units])
        width = int(length.max())
        text = np.zeros((width + 1, n), np.int32)
        text[:width] = np.frombuffer(b"".join(u.ljust(width, b"\0") for u in units), np.uint8).reshape(n, width).T
        inside = np.arange(width + 1)[:, None] < length[None, :]
        starts = inside & (text & 0xC0 != 0x80)
        # First character boundary after each position.
        after = np.full((width + 1, n), 0, np.int32)
        after[width] = length
        for p in range(width - 1, -1, -1):
            after[p] = np.where(inside[p + 1] & ~starts[p + 1], after[p + 1], p + 1)
        best = np.full((width + 1, n), -np.inf)
        best[0] = 0.0
        origin = np.zeros((width + 1, n), np.int32)
        piece = np.full((width + 1, n), -1, np.int32)
        for s in range(width):
            who = np.nonzero(starts[s])[0]
            state = np.zeros(len(who), np.int32)
            covered = np.zeros(n, bool)
            here = best[s]
            for e in range(s, width):
                if not len(who):
                    break
                t = m.base[state] + text[e, who]
                t[t >= len(m.check)] = 0
                go = (m.check[t] == state) & (t > 0) & inside[e, who]
                who, state = who[go], t[go]
                v = m.value[state]
                end = v >= 0
                w, v = who[end], v[end]
                if len(w):
                    covered[w[after[s, w] == e + 1]] = True
                    total = here[w] + m.scores[v]
                    up = total > best[e + 1, w]
                    w, v = w[up], v[up]
                    best[e + 1, w], origin[e + 1, w], piece[e + 1, w] = total[up], s, v
            w = np.nonzero(starts[s] & ~covered)[0]
            if len(w):
                e = after[s, w]
                total = here[w] + m.unknown
                up = total > best[e, w]
                w, e = w[up], e[up]
                best[e, w], origin[e, w], piece[e, w] = total[up], s, -1
        # Walk back; the ids of each step come out last to first.
        place = length.astype(np.int32)
        steps: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        who = np.nonzero(place > 0)[0]
        while len(who):
            e = place[who]
            s, v = origin[e, who], piece[e, who]
            steps.append((who, s, e, v))
            place[who] = s
            who = who[s > 0]
        out: list[list[int]] = [[] for _ in range(n)]
        for who, s, e, v in reversed(steps):
            for i, a, b, x in zip(who.tolist(), s.tolist(), e.tolist(), v.tolist()):
                if x >= 0:
                    out[i].append(x)
                else:
                    out[i].extend(m.byte_ids[c] for c in units[i][a:b])
        return [np.array(x, "<u4").tobytes() for x in out]

    def _learn(self, units: list[str]) -> None:
        raw = [u.encode("utf-8", "replace") for u in units]
        short = sorted((i for i, r in enumerate(raw) if len(r) <= LONG_UNIT), key=lambda i: len(raw[i]))
        for at in range(0, len(short), 4096):  # like lengths together
            part = short[at:at + 4096]
            for i, ids in zip(part, self.segment_many([raw[i] for i in part])):
                self.cache[units[i]] = ids
        for i, r in enumerate(raw):
            if len(r) > LONG_UNIT:
                self.cache[units[i]] = np.array(self.segment_one(r), "<u4").tobytes()

    def encode(self, batch: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; the empty text has none."""
        if len(self.cache) > CACHE_UNITS:
            self.cache.clear()
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in batch]
        units = [UNITS.findall(t) if self.m.by_units else ([t] if t else []) for t in marked]
        new = {u for us in units for u in us if u not in self.cache}
        self._learn(sorted(new))
        get = self.cache.__getitem__
        return [b"".join(map(get, us)) for us in units]

    def decode(self, ids: bytes) -> str:
        """Pieces joined, markers as blanks, without the leading blank. Byte pieces that are
        no valid UTF-8 together become U+FFFD."""
        raw = b"".join(map(self.m.decoded.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


_CODECS: dict[str, PieceCodec] = {}


def _codec(name: str, model) -> PieceCodec:
    if name not in _CODECS:
        _CODECS[name] = PieceCodec(model.value)
    return _CODECS[name]


def shared_model(spark, path: str):
    """The model as a broadcast (its size is the vocabulary's), read once on the driver."""
    python_tasks(spark)
    return spark.sparkContext.broadcast(PieceModel(path))


def encode_pieces(docs: DataFrame, path: str, model=None, text_col: str = "text", out_col: str = "piece_ids") -> DataFrame:
    """``docs`` with ``out_col``: the ids of each whole text, little-endian unsigned 32-bit.

    Null and empty texts have no ids (an empty value). A literal U+2581 counts as a blank. A
    column already called ``out_col`` is replaced; an empty table gives an empty result.
    """
    model = model or shared_model(docs.sparkSession, path)

    @F.pandas_udf("binary")
    def encode(series):
        import pandas as pd
        return pd.Series(_codec(path, model).encode([t or "" for t in series]))

    return docs.withColumn(out_col, encode(F.col(text_col).cast("string")))


def decode_pieces(encoded: DataFrame, path: str, model=None, ids_col: str = "piece_ids", out_col: str = "text") -> DataFrame:
    """``encoded`` with ``out_col``: the text of each row's ids; null ids give the empty text."""
    model = model or shared_model(encoded.sparkSession, path)

    @F.pandas_udf("string")
    def decode(series):
        import pandas as pd
        codec = _codec(path, model)
        return pd.Series([codec.decode(bytes(b or b"")) for b in series])

    return encoded.withColumn(out_col, decode(F.col(ids_col)))
