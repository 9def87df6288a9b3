"""A byte-level BPE vocabulary file as token ids of two bytes, with the pieces' ids kept between texts."""

from __future__ import annotations

import base64
import re
from array import array

#: Where public vocabulary files are; every function takes a path of its own.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END_OF_TEXT = 50256
#: Pieces whose ids a worker keeps; then it starts anew.
KEPT = 150_000

# The vocabulary's own splitting pattern, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# The same pattern for the standard library's re: white space by code point, and letters as word characters
# without digits. Texts with other numbers or marks, for which the two differ, take the slower way.
_WS = "\t\n\x0b\x0c\r \x85\xa0"
_FAST = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\w{_WS}]|_)+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: Beyond the Latin letters, and for the numbers that are no digits, the two differ.
_PLAIN = re.compile("[\u0250-\U0010ffff\xb2\xb3\xb9\xbc-\xbe]")


class Encoder(dict):
    """piece -> its ids, two bytes each, little-endian."""

    def __init__(self, path: str):
        super().__init__()
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if max(ranks.values()) >= END_OF_TEXT:
            raise ValueError(f"ids of {path} don't leave {END_OF_TEXT} free")
        self._all = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._piece = self._all._core_bpe.encode_single_piece

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= KEPT:
            self.clear()
        ids = self[piece] = array("H", self._piece(piece.encode())).tobytes()
        return ids

    def encode(self, text: str) -> bytes:
        if _PLAIN.search(text):
            return array("H", self._all.encode_ordinary(text)).tobytes()
        return b"".join(map(self.__getitem__, _FAST.findall(text)))


_LOADED: dict[str, Encoder] = {}


def encoder(path: str = VOCABULARY) -> Encoder:
    """The encoder of a vocabulary file, loaded once in each process."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]
