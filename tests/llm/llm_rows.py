"""Rows that the operators must take."""

import random
import re


def prose(seed: int, words: int) -> str:
    pick = random.Random(seed)
    return " ".join(f"w{pick.randrange(5000)}{'.' if i % 12 == 11 else ''}" for i in range(words))


#: Repeated rows, null and repeated ids, null, empty and blank texts, one word, a very long text.
ODD = [
    (1, prose(1, 80)),
    (1, prose(1, 80)),
    (2, prose(1, 80)),
    (None, prose(2, 90)),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, "word"),
    (7, prose(3, 30_000)),
    (2, prose(4, 70)),
    (None, None),
]
#: Columns that the operators might use inside.
CLASHING = (
    "score", "label", "held_out", "predicted", "id", "key", "n", "bands", "bucket", "set", "rate", "row", "bucket_id",
    "lang", "source", "n_chars", "task", "place", "length", "edits", "fingerprint", "_text", "_words", "_part", "_cell",
    "_copy", "_key", "_least", "_times", "times", "component", "kept", "moved", "domain", "order",
)


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)
