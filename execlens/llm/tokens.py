"""Token ids of a public byte-level BPE vocabulary, fast on words that recur."""

from __future__ import annotations

import json
import re

import numpy as np

DEFAULT = "byte_bpe_50k.json"
CACHE = 200_000
_UNSAFE = re.compile(r"\s \s")


def tokenizer_path(name: str = DEFAULT) -> str:
    """Where the vocabulary lies on this machine.  Executors ask for themselves."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Cache(dict):
    """Ids of " " + piece, as packed little-endian 32-bit integers."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        made = np.array(self.encode(" " + piece), "<u4").tobytes()
        if len(piece) < 64:
            self[piece] = made
        return made


class BlankSplit:
    """Encodes a text as its pieces between blanks.

    The vocabulary's pre-tokenizer always starts a new piece at a blank that has a non-space
    neighbour, and merges never cross pieces; so the ids of a text are those of its pieces, each
    with the blank before it.  A text with a blank between two spaces is encoded as a whole.
    A text that holds the string of an added token goes to the tokenizer itself, which gives it
    that token's id; add_special_tokens=False only keeps it from adding some of its own.
    """

    def __init__(self, path: str):
        model = json.loads(open(path, encoding="utf-8").read())
        self.path, self.plain = path, None
        added = [x["content"] for x in model.get("added_tokens", [])]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.encode = self._encoder(model)
        self.cache = _Cache(self.encode)

    def whole(self, text: str) -> list[int]:
        if self.plain is None:
            from tokenizers import Tokenizer

            self.plain = Tokenizer.from_file(self.path)
        return self.plain.encode(text, add_special_tokens=False).ids

    def _encoder(self, model: dict):
        try:
            import tiktoken
            from public_tokenizers import PATTERN
        except ImportError:
            return self.whole
        # the same vocabulary as byte ranks: the byte-level alphabet turned back into bytes
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(visible)]
        byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        special = {x["content"] for x in model.get("added_tokens", [])}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, "<u4")
        if self.added and self.added.search(text):
            return np.array(self.whole(text), "<u4")
        if _UNSAFE.search(text) or text[0] == " " or text[-1] == " ":
            return np.array(self.encode(text), "<u4")
        first, *rest = text.split(" ")
        return np.frombuffer(np.array(self.encode(first), "<u4").tobytes() + b"".join(map(self.cache.__getitem__, rest)), "<u4")


_made: dict[str, BlankSplit] = {}


def encoder(path: str | None = None) -> BlankSplit:
    """One encoder a process and vocabulary."""
    path = path or tokenizer_path()
    if path not in _made:
        _made[path] = BlankSplit(path)
    return _made[path]
