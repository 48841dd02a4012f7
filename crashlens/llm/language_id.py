"""Language identification (operator 1): a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into windows of ``WINDOW`` bytes. Two gated recurrent layers read
each window, one from either end; their states at a position give that position's language
probabilities, and a document's probabilities are the mean over all its positions. The
network is trained in numpy by backpropagation through time, on windows of a sample of
labelled documents (at most ``2 * per_label`` expected per language, a documented bound);
prediction covers every byte of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashlens.llm.common import batch_of, python_tasks, texts

WINDOW = 64
HIDDEN = 8
PER_LABEL = 300
WINDOWS_PER_TEXT = 8
BLOCK = 2048  # windows read side by side
UNDETERMINED = "und"


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Parameters of the network; arrays by name. ``langs`` are the learned labels."""

    langs: list[str]
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def fresh(langs: list[str], hidden: int = HIDDEN, seed: int = 1) -> Network:
        rng = np.random.default_rng(seed)
        p = {}
        for d in "fb":
            p["x" + d] = rng.normal(0, 0.3, (3 * hidden, 256))       # byte -> gates z, r, n
            p["u" + d] = rng.normal(0, 0.3, (3 * hidden, hidden))    # state -> gates
            p["c" + d] = np.zeros((3 * hidden, 1))
            p["v" + d] = rng.normal(0, 0.3, (len(langs), hidden))    # state -> languages
        p["o"] = np.zeros((len(langs), 1))
        return Network(langs, {k: v.astype(np.float32) for k, v in p.items()})


def run_layer(p: dict[str, np.ndarray], d: str, x: np.ndarray, keep: bool = False):
    """States (window position, hidden, batch) of one direction over bytes ``x`` (position,
    batch). With ``keep`` also what backpropagation needs."""
    steps, n = x.shape
    table, u = p["x" + d] + p["c" + d], p["u" + d]
    k = u.shape[1]
    h = np.zeros((k, n), np.float32)
    states = np.empty((steps, k, n), np.float32)
    tape = []
    for t in (range(steps) if d == "f" else range(steps - 1, -1, -1)):
        a = np.take(table, x[t], axis=1)
        g = u @ h
        zr = sigmoid(a[:2 * k] + g[:2 * k])
        z, r = zr[:k], zr[k:]
        m = np.tanh(a[2 * k:] + r * g[2 * k:])
        new = m + z * (h - m)
        if keep:
            tape.append((t, h, z, r, m, g[2 * k:]))
        h = states[t] = new
    return states, tape


def position_probabilities(p: dict[str, np.ndarray], x: np.ndarray, keep: bool = False):
    """Language probabilities (position, language, batch)."""
    forward, tape_f = run_layer(p, "f", x, keep)
    backward, tape_b = run_layer(p, "b", x, keep)
    logits = np.matmul(p["vf"], forward) + np.matmul(p["vb"], backward) + p["o"]
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits, {"f": (forward, tape_f), "b": (backward, tape_b)}


def gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, mask: np.ndarray):
    """Mean cross entropy over the real positions and its gradient, through time."""
    probs, layers = position_probabilities(p, x, keep=True)
    steps, _, n = probs.shape
    total = mask.sum()
    loss = -(np.log(probs[:, y, np.arange(n)] + 1e-9) * mask).sum() / total
    err = probs
    err[:, y, np.arange(n)] -= 1.0
    err *= mask[:, None, :] / total
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    grad["o"] = err.sum(axis=(0, 2))[:, None].astype(np.float32)
    for d, (states, tape) in layers.items():
        u = p["u" + d]
        k = u.shape[1]
        grad["v" + d] = np.einsum("tcn,thn->ch", err, states)
        back = np.matmul(p["v" + d].T, err)
        dh = np.zeros((k, n), np.float32)
        for t, h, z, r, m, gn in reversed(tape):
            dh = dh + back[t]
            dm = dh * (1 - z) * (1 - m * m)
            dz = dh * (h - m) * z * (1 - z)
            dr = dm * gn * r * (1 - r)
            gates = np.concatenate([dz, dr, dm])          # wrt byte inputs
            inner = np.concatenate([dz, dr, dm * r])      # wrt state inputs
            np.add.at(grad["x" + d].T, x[t], gates.T)
            grad["c" + d] += gates.sum(axis=1, keepdims=True)
            grad["u" + d] += inner @ h.T
            dh = dh * z + u.T @ inner
    return loss, grad


def train(windows: np.ndarray, lengths: np.ndarray, y: np.ndarray, langs: list[str],
          steps: int = 300, batch: int = 192, rate: float = 0.03, seed: int = 1) -> Network:
    """Adam over random batches; ``windows`` (n, WINDOW) bytes, padded with 0 after ``lengths``."""
    net = Network.fresh(langs, seed=seed)
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(windows), batch)
        x = np.ascontiguousarray(windows[pick].T)
        mask = (np.arange(x.shape[0])[:, None] < lengths[pick][None, :]).astype(np.float32)
        _, grad = gradients(net.p, x, y[pick], mask)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        lr = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for k, g in grad.items():
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            fix = np.sqrt(1 - 0.99 ** step) / (1 - 0.9 ** step)
            net.p[k] = (net.p[k] - lr * fix * first[k] / (np.sqrt(second[k]) + 1e-6)).astype(np.float32)
    return net


def cut_windows(raw: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all byte strings: (window, n) bytes, lengths, and the owner of each."""
    sizes = np.array([len(b) for b in raw], np.int64)
    counts = -(-sizes // window)
    owner = np.repeat(np.arange(len(raw)), counts)
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = base[owner] + inside * window
    length = np.minimum(window, sizes[owner] - inside * window)
    flat = np.frombuffer(b"".join(raw) + bytes(window), np.uint8)
    x = flat[start[None, :] + np.arange(window)[:, None]]
    x[np.arange(window)[:, None] >= length[None, :]] = 0
    return x, length, owner


def document_probabilities(net: Network, batch: list[str]) -> np.ndarray:
    """(texts, languages) mean position probabilities; zeros for a text without bytes."""
    out = np.zeros((len(batch), len(net.langs)))
    raw = [t.encode("utf-8", "surrogatepass") for t in batch]
    first = 0
    while first < len(raw):  # a few MB of bytes at a time
        last, held = first, 0
        while last < len(raw) and (held == 0 or held + len(raw[last]) <= 4 << 20):
            held += len(raw[last])
            last += 1
        part = raw[first:last]
        x, length, owner = cut_windows(part)
        total = np.zeros((len(net.langs), len(owner)))
        for i in range(0, len(owner), BLOCK):
            block = np.ascontiguousarray(x[:, i:i + BLOCK])
            probs, _ = position_probabilities(net.p, block)
            mask = np.arange(len(block))[:, None] < length[None, i:i + BLOCK]
            total[:, i:i + BLOCK] = (probs * mask[:, None, :]).sum(axis=0)
        for c in range(len(net.langs)):
            out[first:last, c] = np.bincount(owner, total[c], len(part))
        first = last
    sizes = np.array([max(1, len(b)) for b in raw])
    return out / sizes[:, None]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def learn_languages(docs: DataFrame, label_col: str = "lang", text_col: str = "text",
                    id_col: str = "doc_id", per_label: int = PER_LABEL) -> Network | None:
    """Train on ``docs``; None if no labelled text has a letter.

    Per language, rows whose hashed id falls below ``2 * per_label / rows`` are the sample, and
    its first ``per_label`` by hash are used (an expected ``2 * per_label`` ids reach the
    driver). Of each text up to ``WINDOWS_PER_TEXT`` windows, spread evenly over its whole
    length, are the training data.
    """
    python_tasks(docs.sparkSession)
    rows = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()
                      ).select(F.col(id_col).alias("i"), F.col(label_col).cast("string").alias("l"))
    counts = {r[0]: r[1] for r in rows.groupBy("l").agg(F.count("*")).collect()}
    if not counts:
        return None
    scale = 1 << 30
    h = F.pmod(F.xxhash64("i", F.lit(1)), F.lit(scale))
    # One comparison per language of the (small) label set.
    below = F.lit(False)
    for lang, n in counts.items():
        below |= (F.col("l") == lang) & (h < F.lit(int(min(1.0, 2 * per_label / n) * scale)))
    chosen: dict[str, list] = {}
    for i, lang, _ in sorted(rows.where(below).select("i", "l", h.alias("h")).distinct().collect(),
                             key=lambda r: (r[2], r[0])):
        ids = chosen.setdefault(lang, [])
        if len(ids) < per_label:
            ids.append(i)
    # An id in the table under two labels counts for the first label alone.
    label_of: dict = {}
    for lang in sorted(chosen):
        for i in chosen[lang]:
            label_of.setdefault(i, lang)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("i", pa.int64()), ("window", pa.binary())])
        for b in batches:
            ids, out = [], []
            for i, t in zip(b.column("i").to_pylist(), texts(b)):
                if has_letter(t):
                    raw = t.encode("utf-8", "surrogatepass")
                    for at in np.unique(np.linspace(0, max(0, len(raw) - WINDOW), WINDOWS_PER_TEXT).astype(int)):
                        ids.append(i)
                        out.append(raw[at:at + WINDOW])
            yield batch_of(schema, [ids, out])

    data = (docs.where(F.col(id_col).isin(list(label_of)) & F.col(text_col).isNotNull())
            .select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(windows, "i long, window binary").collect())
    data = sorted((r[0], bytes(r[1])) for r in data)
    langs = sorted({label_of[i] for i, _ in data})
    if not langs:
        return None
    x = np.array([np.frombuffer(w.ljust(WINDOW, b"\0"), np.uint8) for _, w in data])
    return train(x, np.array([len(w) for _, w in data]),
                 np.array([langs.index(label_of[i]) for i, _ in data]), langs)


def identify_language(docs: DataFrame, network: Network | None, text_col: str = "text",
                      lang_col: str = "lang_pred", score_col: str = "lang_score") -> DataFrame:
    """``docs`` with ``lang_col`` and ``score_col`` (mean probability of that language).

    Texts that are null or hold no letter get ``und`` with score 0, as does every text when
    there is no network. Columns already called so are replaced; repeated rows and null ids
    stay as they are; an empty table gives an empty result.
    """
    python_tasks(docs.sparkSession)

    @F.pandas_udf("struct<lang:string,score:double>")
    def predict(series):
        import pandas as pd
        batch = [t or "" for t in series]
        known = np.array([network is not None and has_letter(t) for t in batch], bool)
        lang = np.full(len(batch), UNDETERMINED, object)
        score = np.zeros(len(batch))
        if known.any():
            probs = document_probabilities(network, [t for t, k in zip(batch, known) if k])
            lang[known] = np.array(network.langs, object)[probs.argmax(axis=1)]
            score[known] = np.clip(probs.max(axis=1), 0.0, 1.0)
        return pd.DataFrame({"lang": lang, "score": score})

    found = docs.withColumn(lang_col, predict(F.col(text_col).cast("string")))
    return found.withColumns({score_col: F.col(lang_col)["score"], lang_col: F.col(lang_col)["lang"]})
