"""Tokenizer ids of whole texts, by a cache of the ids of space-separated chunks.

A pre-token's ids do not depend on its neighbours, so the tokenizers library's
own model encodes the pre-tokens of each distinct chunk once per worker, and
texts are joined from caches of pre-tokens and of chunks. Texts with characters for which the
library's normaliser or Unicode tables matter, or with the string of a special
token, go through the library whole, as do all texts if the file's sections are
not those that this is made for. (Giving whole texts to the library takes
five times as long, and chunks twice: 438 CPU seconds a GB in op1, over its
budget of 400.)
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

_L = "A-Za-zªµºÀ-ÖØ-öø-ſ"
_N = "0-9²³¹¼-¾"
_APOS = "'s|'t|'re|'ve|'m|'ll|'d"
_UNUSUAL = re.compile("[^\t\n\r -~¡-įı-ſ]")
_SPACES = ("  ", "\n\n", " \n", "\n ", "\t", "\r")
#: By pre-tokenizer kind: pattern of pre-tokens.
PATTERNS = {
    "byte": re.compile(rf"{_APOS}| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+"),
    "word": re.compile(rf"{_APOS}|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+"),
}


# The sections of tokenizer files that PATTERNS stands for.
SECTIONS = {
    "byte": {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}},
    "word": {
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": rf"{_APOS}|[\p{{L}}]+|[\p{{N}}]|[^\s\p{{L}}\p{{N}}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}]},
    },
}


def known(path: str, kind: str) -> bool:
    """Whether a tokenizer file splits texts as PATTERNS does for that kind, and marks its special tokens with "<|"."""

    def plain(v):
        # offsets do not change ids
        return {k: plain(x) for k, x in v.items() if k != "trim_offsets"} if isinstance(v, dict) else [plain(x) for x in v] if isinstance(v, list) else v

    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    return all(plain(d.get(k)) == v for k, v in SECTIONS[kind].items()) and d["model"]["type"] == "BPE" and all("<|" in t["content"] for t in d.get("added_tokens") or [])


def _shown() -> dict[int, str]:
    """How byte-level vocabularies write the bytes that are no visible character: by those after the first 256, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}


_SHOWN = _shown()


class Encoder:
    """encode(texts) -> one uint32 array a text. path: a tokenizers JSON file of that kind.

    plain_special: take the strings of special tokens as ordinary text.
    The caches are emptied when they hold cache_size entries, which bounds memory.
    """

    def __init__(self, path: str, kind: str, plain_special: bool = False, cache_size: int = 2_400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = plain_special
        self.model = self.tok.model
        self.pattern, self.lower, self.known = PATTERNS[kind], kind == "word", known(path, kind)
        self.chunks, self.pieces, self.cache_size = _Cache(self._chunk), _Cache(self._piece), cache_size
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")

    def _plain(self, text: str) -> bool:
        return self.known and "<|" not in text and not _UNUSUAL.search(text)

    def _chunks(self, text: str) -> list[str]:
        """Parts with independent ids: any white space for words, " x" and "\\nx" for bytes."""
        if self.lower:
            return text.lower().split()
        if any(s in text for s in _SPACES) or text[:1].isspace() or text[-1:].isspace():
            return self.pattern.findall(text)
        return (text.replace("\n", " \n") if "\n" in text else text).replace(" ", " \x00").replace("\x00\n", "\n").split(" ")

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(chunk.replace("\x00", " "))))

    def _piece(self, piece: str) -> bytes:
        return np.array([t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(_SHOWN))], self.dtype).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out, get = [], self.chunks.__getitem__
        for t in texts:
            if not self._plain(t):
                out.append(np.array(self.tok.encode(t, add_special_tokens=False).ids, dtype=np.uint32))
                continue
            for cache in (self.chunks, self.pieces):
                if len(cache) > self.cache_size // 2:
                    cache.clear()
            out.append(np.frombuffer(b"".join(map(get, self._chunks(t))), dtype=self.dtype).astype(np.uint32))
        return out


class _Cache(dict):
    """Values by key, made when first asked for."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key: str) -> bytes:
        value = self[key] = self.make(key)
        return value


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, kind: str, plain_special: bool = False, cache_size: int = 2_400_000) -> Encoder:
    """This worker process's encoder."""
    key = (path, kind, plain_special, cache_size)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]
