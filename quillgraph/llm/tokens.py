"""Token ids of whole texts by a public tokenizer file.

The vocabulary's pattern never joins a character that isn't white space with a
space that follows it, so a text can be cut before each space that follows such
a character and the parts encoded apart: the ids are those of the whole text.  Parts repeat
(they are words with their space and punctuation), so a worker keeps the ids of
the parts it has seen and asks the tokenizer for new ones only.
"""

from __future__ import annotations

import re
from array import array
from functools import cached_property, lru_cache

import numpy as np

from quillgraph.llm.common import trim

DEFAULT_FILE = "byte_bpe_50k.json"
END = np.array([0], "<u4").tobytes()
_CUT = re.compile(r"(?<=\S) ")
_RUN = re.compile(r"\s ")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_FILE)


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    table |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return table


def ranked(path: str):
    """The same vocabulary as ranks for the faster matcher, or None where its merges aren't in the order of their ids."""
    import json
    from pathlib import Path

    import public_tokenizers
    import tiktoken

    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or spec.get("normalizer"):
        return None
    byte, extra = _byte_of(), {x["content"] for x in spec.get("added_tokens", [])}
    merged = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ids = [model["vocab"].get(a + b, -1) for a, b in merged]
    if any(x >= y for x, y in zip(ids, ids[1:], strict=False)):
        return None
    ranks = {bytes(byte[c] for c in word): i for word, i in model["vocab"].items() if word not in extra}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Parts(dict):
    """The ids of parts after a space; a part that isn't known is encoded when it is asked for, and kept if it isn't long.

    At most `keep` parts are held, and as many of the time before.
    """

    def __init__(self, encode, keep: int, longest: int):
        super().__init__()
        self.encode, self.keep, self.longest = encode, keep, longest
        self.older: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        ids = self.older.get(part)
        if ids is None:
            ids = self.encode(" " + part)
        if len(part) <= self.longest:
            if len(self) >= self.keep:
                self.older = dict(self)
                self.clear()
            self[part] = ids
        return ids


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit bytes; `keep` bounds the parts that are remembered."""

    def __init__(self, path: str | None = None, keep: int = 200_000, longest: int = 64):
        self.path = path or default_path()
        fast = ranked(self.path)
        self.one = fast and fast._core_bpe.encode_ordinary
        self.parts = Parts(self.ids, keep, longest)
        trim()  # the file's text and tables

    @cached_property
    def model(self):
        """The tokenizer library's own, read where it is needed."""
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(self.path)
        model.encode_special_tokens = True  # their strings are ordinary text
        return model

    def slow(self, texts: list[str]) -> list[bytes]:
        """The ids as the tokenizer library itself gives them."""
        return [np.array(x.ids, "<u4").tobytes() for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, text: str) -> bytes:
        return array("I", self.one(text)).tobytes() if self.one else self.slow([text])[0]

    def encode(self, texts: list[str]) -> list[bytes]:
        get, out = self.parts.__getitem__, []
        for text in texts:
            if not text.isascii():
                text = text.encode("utf-8", "replace").decode()
            head, *rest = _CUT.split(text) if _RUN.search(text) else text.split(" ")
            out.append(self.ids(head) + b"".join(map(get, rest)))
        return out


@lru_cache(maxsize=2)
def encoder(path: str | None = None) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path)
