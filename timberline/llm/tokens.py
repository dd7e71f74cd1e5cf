"""Token ids of whole texts with a tokenizer file, at the speed of a dictionary.

Tokenizers that lower-case, drop white space and never merge across it give a text the ids of
its white-space separated chunks, one after the other. A worker keeps the chunks it has seen;
only new ones reach the tokenizers library. Other tokenizer files encode text by text.
"""

from __future__ import annotations

import json
import os
import re
import struct

import numpy as np

from timberline.llm.common import worker_state

#: chunks kept by a worker; about 150 bytes each
KEPT = 1_000_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _splits_at_spaces(path: str) -> str | None:
    """The split pattern if a text's ids are those of its chunks, else None."""
    with open(path, encoding="utf-8") as f:
        conf = json.load(f)
    kinds = [(n["type"], n.get("content")) for n in (conf.get("normalizer") or {}).get("normalizers", [])]
    pre = (conf.get("pre_tokenizer") or {}).get("pretokenizers", [])
    model = conf["model"]
    if (kinds == [("NFC", None), ("Replace", " "), ("Lowercase", None)] and len(pre) == 2
            and pre[0]["type"] == "Split" and pre[0]["behavior"] == "Removed" and pre[0]["invert"]
            and pre[1]["type"] == "ByteLevel" and not pre[1]["add_prefix_space"] and not pre[1]["use_regex"]
            and model["type"] == "BPE" and not model.get("dropout")
            and not any(any(c.isspace() for c in t["content"]) for t in conf["added_tokens"])):
        return pre[0]["pattern"].get("Regex")
    return None


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class Encoder(dict):
    """Chunk -> little-endian unsigned 32-bit ids; ``encode`` does whole texts."""

    # letters whose lower case and normal form no library disagrees on
    _PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]{1,64}")
    # Python splits at these, the tokenizer doesn't
    _UNUSUAL = re.compile("[\x1c-\x1f]")

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self._full = Tokenizer.from_file(path)
        pattern = _splits_at_spaces(path)
        self._split = regex.compile(pattern).findall if pattern else None
        self._model = self._full.model
        self._letters = _byte_letters()
        self._words: dict[str, bytes] = {}

    def _library(self, text: str) -> bytes:
        return np.array(self._full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        got = self._words.get(word)
        if got is None:
            letters = word if word.isascii() else "".join(map(self._letters.__getitem__, word.encode()))
            ids = [t.id for t in self._model.tokenize(letters)]
            got = struct.pack(f"<{len(ids)}I", *ids)
            self._words[word] = got
        return got

    def __missing__(self, chunk: str) -> bytes:
        if len(self) + len(self._words) > KEPT:
            self.clear()
            self._words.clear()
        if "<|" in chunk or not self._PLAIN.fullmatch(chunk):
            ids = self._library(chunk)
        else:
            ids = b"".join(map(self._word, self._split(chunk.lower())))
        if len(chunk) <= 64:
            self[chunk] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text (null: empty) as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self._split is None or self._UNUSUAL.search(text):
            return self._library(text)
        return b"".join(map(self.__getitem__, text.split()))


def encoder(path: str | None = None) -> Encoder:
    """The worker's encoder of a tokenizer file."""
    path = path or default_path()
    return worker_state(("encoder", path), lambda: Encoder(path))
