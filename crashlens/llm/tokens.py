"""Byte-level BPE ids of whole texts.

The vocabulary file is the ``tokenizers`` JSON (``model.vocab``); its ids are in merge
order, so the same vocabulary serves as the rank table of ``tiktoken``, which gives the
same ids several times faster. ``tests/llm/test_tokens.py`` holds the two against each
other.
"""

from __future__ import annotations

import json

import numpy as np

#: Fixed value: how byte-level BPE of this family cuts a text before merging.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_ENCODERS: dict[str, BpeEncoder] = {}


def byte_stand_ins() -> dict[str, int]:
    """Byte-level BPE files write each byte as a printable character: printable Latin-1
    characters stand for themselves, the others follow from 256 on, in byte order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BpeEncoder:
    def __init__(self, path: str):
        import tiktoken
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens") or () if t.get("special")}
        to_byte = byte_stand_ins()
        ranks = {bytes(to_byte[c] for c in token): i
                 for token, i in spec["model"]["vocab"].items() if token not in special}
        self.special = special
        self.size = max(spec["model"]["vocab"].values()) + 1
        self.sentence_end = np.zeros(self.size, bool)
        for token, i in ranks.items():
            self.sentence_end[i] = token[-1:] in (b".", b"!", b"?") or b"\n" in token
        encoding = tiktoken.Encoding(path, pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens=special)
        self.encode_plain = encoding.encode_ordinary
        self.encode_special = lambda text: encoding.encode(text, allowed_special="all")

    def encode(self, text: str, end_id: int | None = None, special: bool = True) -> np.ndarray:
        """The ids of a whole text, with ``end_id`` after them if given. A special token's string
        in the text becomes that token, as with the ``tokenizers`` library's defaults; with
        ``special=False`` it is ordinary text."""
        ids = self.encode_special(text) if special and any(t in text for t in self.special) else self.encode_plain(text)
        if end_id is not None:
            ids.append(end_id)
        return np.array(ids, "<u4")


def encoder(path: str) -> BpeEncoder:
    """The worker's encoder for a vocabulary file, made once per process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = BpeEncoder(path)
    return _ENCODERS[path]
