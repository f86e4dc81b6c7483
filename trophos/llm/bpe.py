"""Byte-level BPE ids of texts, from a public tokenizer file.

The file is the JSON of the ``tokenizers`` library; ids equal those of its
``encode(text, add_special_tokens=False)``.  Pre-tokens are encoded by the
faster ``tiktoken`` from the same vocabulary, and those seen before are looked
up.  A text is cut at each space that a non-space follows: there the pattern
always begins a new pre-token, so the parts can be encoded one by one.
"""

import functools
import json
import re

import numpy as np
import tiktoken

# Fixed value: the pattern of byte-level pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Looked-up parts that a Python worker keeps, and their greatest length.
CACHE_PARTS, CACHE_LENGTH = 400_000, 48

_CUT, _OTHER_SPACE = re.compile(r" (?=\S)"), re.compile(r" (?!\S)")


def _alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte, vocab = _alphabet(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in self.special}
        merges = [m if isinstance(m, str) else " ".join(m) for m in spec["model"]["merges"]]
        if any(vocab[m.replace(" ", "", 1)] != 256 + i for i, m in enumerate(merges)):
            raise ValueError(f"{path}: ids are not in the order of the merges")
        self.bpe = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.mark = re.compile(f"({'|'.join(map(re.escape, self.special))})") if self.special else None
        self.known: dict[str, bytes] = {}

    def _plain(self, text: str) -> bytes:
        return np.array(self.bpe.encode_ordinary(text), "<u4").tobytes()

    def _ordinary(self, text: str) -> bytes:
        parts = _CUT.split(text) if _OTHER_SPACE.search(text) else text.split(" ")
        first = self._plain(parts[0])
        found = list(map(self.known.get, parts))
        found[0] = first
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    part = parts[i]
                    found[i] = ids = self.known.get(part) or self._plain(" " + part)
                    if len(part) <= CACHE_LENGTH:
                        self.known[part] = ids
            if len(self.known) > CACHE_PARTS:
                self.known.clear()
        return b"".join(found)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if self.mark is None or not self.mark.search(text):
            return self._ordinary(text)
        pieces = self.mark.split(text)
        return b"".join(
            self.special[p].to_bytes(4, "little") if i % 2 else self._ordinary(p) for i, p in enumerate(pieces) if p
        )


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder for each file in a Python worker."""
    return Encoder(path)
