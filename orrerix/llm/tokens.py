"""Tokenisation with a memo of words.

Of a tokenizer with the normalizer and the pre-tokenizer that are known here, a
text of plain letters, digits and ASCII marks is cut into the same pre-tokens
that its own pipeline makes, and the ids of a pre-token come from the library
once per worker.  Any other text (other scripts, combining marks, strings of
special tokens), and every text of any other tokenizer, goes to the library as
it is.  ``tests/llm`` compares both ways on the same texts.
"""

from __future__ import annotations

import array
import json
import os
import re
import sys
from functools import lru_cache

WORD_BPE = "word_bpe_49k.json"
#: Pre-tokens to keep in a worker; the memo starts anew beyond that.
MEMO_WORDS = 400_000

_LETTERS = "a-zß-öø-ÿ"
_PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+")


#: The settings that the memo's own cutting follows.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def is_known(settings: dict) -> bool:
    """Whether a tokenizer's settings are those that the memo follows."""
    return (
        settings.get("normalizer") == _NORMALIZER
        and settings.get("pre_tokenizer") == {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]}
        and not any(settings.get(k) for k in ("post_processor", "truncation", "padding"))
        and settings.get("model", {}).get("type") == "BPE"
        and not settings["model"].get("dropout")
        and all("<|" in t["content"] for t in settings.get("added_tokens", ()))
    )


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(WORD_BPE)


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level BPE shows for each byte, by its published rule."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Memo(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, bare):
        super().__init__()
        self.bare, self.letters = bare, _byte_letters()

    def __missing__(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        self[piece] = made = _little(self.bare.encode(shown, add_special_tokens=False).ids)
        return made


def _little(ids: list[int]) -> bytes:
    packed = array.array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class Encoder:
    """Ids of whole texts, as bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.known = is_known(json.loads(self.full.to_str()))
        self.memo = _Memo(Tokenizer(self.full.model))
        self.vocabulary = self.full.get_vocab_size()

    def encode(self, text: str) -> bytes:
        if not self.known or "<|" in text or not _PLAIN.fullmatch(text):
            return _little(self.full.encode(text, add_special_tokens=False).ids)
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        return b"".join(map(self.memo.__getitem__, _PIECES.findall(text.lower())))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each file in a Python worker."""
    return Encoder(path)
