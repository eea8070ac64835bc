"""Byte-level BPE tokenizers read from a ``tokenizers`` JSON file.

The file's own library is the reference. Where the file describes a plain
byte-level BPE (no normaliser, no prefix space, ranks in merge order) the same
ids come faster from a rank-based encoder; texts with one of the file's special
strings always go through the file's library.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import regex

# Fixed value: the split pattern of byte-level BPE with "use_regex".
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    odd = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}


class Bpe:
    """One tokenizer file: ids of texts, ids of pre-tokens, and which strings are one token."""

    def __init__(self, path: str):
        import tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.specials = [x["content"] for x in spec.get("added_tokens", [])]
        self.size = self.library.get_vocab_size()
        added = {x["id"] for x in spec.get("added_tokens", [])}
        place = _byte_characters()
        self.plain = (
            model.get("type") == "BPE"
            and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and pre.get("use_regex", True)
            and spec.get("normalizer") is None
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
            and all(c in place for s, i in model["vocab"].items() if i not in added for c in s)
        )
        if not self.plain:
            return
        ranks = {bytes(place[c] for c in s): i for s, i in model["vocab"].items() if i not in added}
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        self.plain = merged == sorted(merged) and all(bytes([b]) in ranks for b in range(256))
        if self.plain:
            import tiktoken

            self.fast = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.split = regex.compile(PATTERN)
            self.strings = [s for s in map(_utf8, ranks) if s]

    def ids(self, text: str) -> np.ndarray:
        """Ids of a text, as the file's library gives them without added special tokens."""
        if self.plain and not any(s in text for s in self.specials):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except (ValueError, RuntimeError):
                pass  # the pattern engine gives up on some very long runs
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def whole(self) -> list[str]:
        """Proof by trial: the vocabulary strings that the library encodes, alone, as one token."""
        found = self.library.encode_batch(self.strings, add_special_tokens=False)
        return [s for s, e in zip(self.strings, found) if len(e.ids) == 1 and self.split.findall(s) == [s]]


def _utf8(raw: bytes) -> str | None:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return None


@lru_cache(4)
def load(path: str) -> Bpe:
    return Bpe(path)
