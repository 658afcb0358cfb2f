"""Byte-level BPE encoding with the ids of the tokenizers library.

The library itself encodes some 2 MB a second and core here.  Its file fully fixes
the result (byte-level splits, then merges in rank order), so the vocabulary is
handed to the tiktoken engine, which applies the same split and the same merges at
over 9 MB a second.  Whether a file qualifies is read from the file; a probe is
encoded by both when a worker starts; texts with characters for which the two
splitters' Unicode tables may differ go to the library, as does any other file.
"""

from __future__ import annotations

import json
import re

import numpy as np

_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PROBE = "It's 12 tests,\n\n  they'll  pass\t— naïve façade № 7 — ½ Ωmega жук 漢字 \U0001f600!!  <x> 'S\r\n "
#: Scripts whose letters' classes are settled in every Unicode version in use; see tests.
_SETTLED = re.compile("[^\x00-ͯΑ-ΡΣ-ϿЀ-ҁҊ-ԯ‐-‧‰-⁞₠-₿℀-↋←-⏿─-➿、-〩ぁ-ゖァ-ヺ一-龥가-힣！-～\U0001f300-\U0001f5ff\U0001f600-\U0001f64f]")


def byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Encodes texts as ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` does."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.fast = None
        self.special: list[str] = []
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if _qualifies(spec):
            import tiktoken

            to_byte = byte_chars()
            special = {t["content"]: t["id"] for t in spec["added_tokens"]}
            ranks = {bytes(to_byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
            self.fast = tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens=special)
            self.special = list(special)
            probe = _PROBE + "".join(self.special) + _PROBE
            if self._quick(probe).tolist() != self.library.encode(probe, add_special_tokens=False).ids:
                self.fast = None

    def _quick(self, text: str) -> np.ndarray:
        allowed = set(self.special) if any(s in text for s in self.special) else set()
        return self.fast.encode_to_numpy(text, allowed_special=allowed, disallowed_special=())

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of the whole text, as uint32; none for a null or empty text."""
        if not text:
            return np.zeros(0, np.uint32)
        if self.fast is not None and (text.isascii() or not _SETTLED.search(text)):
            return self._quick(text)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


def _qualifies(spec: dict) -> bool:
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    split = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    bare = all(not spec.get(k) for k in ("normalizer", "post_processor", "truncation", "padding"))
    added = all(not (t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized")) for t in spec["added_tokens"])
    if not (plain and split and bare and added):
        return False
    vocab = model["vocab"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ids = [vocab[a + b] for a, b in merges]
    singles = {vocab.get(c) for c in byte_chars()}
    return ids == sorted(ids) and len(set(ids)) == len(ids) and len(singles) == 256 and None not in singles and max(singles) < (ids[0] if ids else 256)


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a file, loaded once in each process."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
