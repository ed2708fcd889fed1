"""Token ids of whole texts by a byte-level BPE file of the `tokenizers` library."""

from __future__ import annotations

import json
import re

import numpy as np


#: A run of white space on which the other library's pattern engine would run out of stack.
_LONG_GAP = re.compile(r"\s{1000}")


def _byte_chars() -> list[str]:
    """The printable stand-in that byte-level vocabularies write for each byte."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class ByteBpe:
    """Ids of a byte-level BPE file, equal to `Tokenizer.from_file(path).encode(text, add_special_tokens=False)`.

    Where every merge's piece has a larger id than the merge before it, ids are ranks, and `tiktoken` gives the same
    ids from them in half the time. Other files, and texts that hold a special token's string or a very long run of
    white space, go to the library.
    """

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        made = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
        byte_of = {c: b for b, c in enumerate(_byte_chars())}
        plain = {p: i for p, i in model["vocab"].items() if p not in self.special}
        self.pieces = [b""] * (max(model["vocab"].values(), default=-1) + 1)
        for p, i in model["vocab"].items():
            self.pieces[i] = bytes(byte_of[c] for c in p) if all(c in byte_of for c in p) else p.encode()
        self.size = len(self.pieces)
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)
        self.plain_tok: Tokenizer | None = None
        self.ranked = None
        if all(x < y for x, y in zip(made, made[1:], strict=False)) and all(c in byte_of for p in plain for c in p):
            ranks = {bytes(byte_of[c] for c in p): i for p, i in plain.items()}
            self.ranked = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of the whole text."""
        if self.ranked is None or any(s in text for s in self.special) or _LONG_GAP.search(text):
            found = self.tok.encode(text, add_special_tokens=False).ids
        else:
            found = self.ranked.encode_ordinary(text)
        return np.array(found, "<u4").tobytes()


    def plain_ids(self, text: str) -> list[int]:
        """Ids of a whole text, in which a special token's string is plain text."""
        if self.ranked is not None and not _LONG_GAP.search(text):
            return self.ranked.encode_ordinary(text)
        if self.plain_tok is None:
            self.plain_tok = type(self.tok).from_str(self.tok.to_str())
            self.plain_tok.encode_special_tokens = True
        return self.plain_tok.encode(text, add_special_tokens=False).ids

    def text(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


class PieceBpe:
    """Ids and bytes of a sentencepiece model."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.size = self.model.vocab_size()
        shown = [self.model.id_to_piece(i) for i in range(self.size)]
        self.pieces = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(shown)]
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text)

    def text(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


_loaded: dict[tuple[str, str], ByteBpe] = {}
_models: dict[str, PieceBpe] = {}


def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """One encoder for each worker process."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBpe(path, pattern)
    return _loaded[path, pattern]


def piece_bpe(path: str) -> PieceBpe:
    if path not in _models:
        _models[path] = PieceBpe(path)
    return _models[path]
