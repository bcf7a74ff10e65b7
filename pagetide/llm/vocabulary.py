"""Bytes behind the printable characters of byte-level vocabularies."""

from __future__ import annotations

import json

_KEPT = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: Printable bytes stand for themselves; the others follow from U+0100 on, in order.
BYTE_OF = {chr(b): b for b in _KEPT} | {chr(0x100 + i): b for i, b in enumerate(sorted(set(range(256)) - set(_KEPT)))}


def token_bytes(path: str) -> list[bytes]:
    """Bytes of each id of a byte-level tokenizer file; special tokens are their own text."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    vocab = dict(spec["model"]["vocab"]) | {t["content"]: t["id"] for t in spec["added_tokens"]}
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes(BYTE_OF[c] for c in token) if all(c in BYTE_OF for c in token) else token.encode()
    return out
