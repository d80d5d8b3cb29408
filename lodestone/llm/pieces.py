"""Encoding with a public vocabulary, one word piece at a time.

A tokenizer's pre-tokenizer splits a text into pieces that are merged on their own, so the ids of a text are those of its
pieces in order. Pieces repeat; each Python worker keeps the ids of the pieces it has met (at most CACHE_PIECES, then it
starts afresh) and asks the tokenizers library only for new ones. Texts with characters outside a checked alphabet go
through the library as a whole, so the split never depends on a second implementation of Unicode tables.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

import numpy as np

from .common import claim

CACHE_PIECES = 450_000

#: Characters up to U+024F (and general punctuation) by class, as in the patterns of both vocabularies.
LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBER = "0-9²³¹¼-¾"
SPACE = "\t\n\x0b\x0c\r "
OUTSIDE = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e¡-ɏ‐-‧‰-⁞€]")
def checked(kind: str) -> re.Pattern[str]:
    """Matches a character outside the checked alphabet. Of the alphabet of lower-cased words, characters are left out whose
    small form is not in it: their classes are unknown here."""
    inside = [c for c in range(0x2070) if not OUTSIDE.match(chr(c)) and (kind == "byte" or not OUTSIDE.search(chr(c).lower()))]
    firsts = [c for c, before in zip(inside, [-1, *inside]) if c != before + 1]
    lasts = [c for c, after in zip(inside, [*inside[1:], -1]) if after != c + 1]
    return re.compile("[^€" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(firsts, lasts)) + "]")


SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
BYTE_PIECE = re.compile(f"{SHORT}| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
WORD_PIECE = re.compile(f"{SHORT}|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+")

#: Pieces that are handed to the library in one call.
BATCH = 1000

_LOADED: dict[tuple[str, str], "PieceEncoder"] = {}


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for each byte: printable ones as they are, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Encoded:
    """Ids, and the index of the first token of each piece."""

    ids: np.ndarray
    starts: np.ndarray

    def __len__(self) -> int:
        return len(self.ids)


class PieceEncoder:
    """`kind` is "byte" (byte-level pieces, white space kept) or "word" (lower-cased words, white space dropped)."""

    def __init__(self, path: str, kind: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.kind = kind
        self.find = (BYTE_PIECE if kind == "byte" else WORD_PIECE).findall
        self.special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.first_signs = {s[0] for s in self.special}
        for t in self.tok.get_added_tokens_decoder().values():
            if t.lstrip or t.rstrip or t.single_word or (t.normalized and self.tok.normalizer is not None):
                raise ValueError(f"the added token {t.content} is not matched as it stands, so texts cannot be split at it")
        self.outside = checked(kind).search
        self.cache: dict[str, bytes] = {}
        # The same model behind a split at blanks: pieces are in its byte letters already, so none holds a blank.
        self.model = Tokenizer(self.tok.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = {b: c for c, b in byte_letters().items()}
        suffix = self.tok.model.end_of_word_suffix or ""
        vocab = self.tok.get_vocab(with_added_tokens=False)
        self.lengths = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        for token, i in vocab.items():
            self.lengths[i] = len(token.removesuffix(suffix)) if suffix else len(token)

    def _learn(self, pieces: list[str]) -> None:
        if len(self.cache) + len(pieces) > CACHE_PIECES:
            self.cache.clear()
        for a in range(0, len(pieces), BATCH):
            part = pieces[a : a + BATCH]
            mapped = [p.encode("utf-8").decode("latin-1").translate(self.letters) for p in part]
            ids = np.array(self.model.encode_batch_fast([" ".join(mapped)], add_special_tokens=False)[0].ids, dtype=np.uint32)
            ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(m) for m in mapped])) + 1
            raw, at = ids.tobytes(), 0
            for p, end in zip(part, (4 * ends).tolist()):
                self.cache[p] = raw[at:end]
                at = end

    def _pieces(self, text: str) -> list[bytes]:
        """The ids of each piece, as little-endian bytes, for a text of the checked alphabet."""
        pieces = self.find(text if self.kind == "byte" else text.lower())
        cache = self.cache
        try:
            return [cache[p] for p in pieces]
        except KeyError:
            self._learn(list({p for p in pieces if p not in cache}))
            cache = self.cache
            return [cache[p] if p in cache else self._one(p) for p in pieces]

    def _one(self, piece: str) -> bytes:
        return np.array(self.tok.encode(piece, add_special_tokens=False).ids, dtype=np.uint32).tobytes()

    def _plain(self, text: str) -> bytes:
        if self.outside(text):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype=np.uint32).tobytes()
        return b"".join(self._pieces(text))

    def segments(self, text: str) -> list[tuple[str, int | None]]:
        """Parts without special strings, each with the id of the special string behind it."""
        if not any(c in text for c in self.first_signs):
            return [(text, None)]
        parts = self.at_special.split(text)
        return [(parts[i], self.special[parts[i + 1]] if i + 1 < len(parts) else None) for i in range(0, len(parts), 2)]

    def encode(self, text: str) -> np.ndarray:
        parts = self.segments(text)
        if len(parts) == 1:
            return np.frombuffer(self._plain(text), dtype=np.uint32)
        return np.frombuffer(b"".join(self._plain(s) + (b"" if i is None else np.uint32(i).tobytes()) for s, i in parts), dtype=np.uint32)

    def encode_split(self, text: str) -> Encoded:
        """Ids with piece starts, for a text without special strings."""
        if self.outside(text):
            e = self.tok.encode(text, add_special_tokens=False)
            words = np.array([-1 if w is None else w for w in e.word_ids], dtype=np.int64)
            return Encoded(np.array(e.ids, dtype=np.uint32), np.flatnonzero(np.diff(words, prepend=-2)))
        found = self._pieces(text)
        counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        return Encoded(np.frombuffer(b"".join(found), dtype=np.uint32), np.cumsum(counts) - counts)


def encoder(path: str, kind: str) -> PieceEncoder:
    """The worker's own encoder, kept between tasks."""
    claim(f"pieces {path} {kind}", lambda: _LOADED.pop((path, kind), None))
    if (path, kind) not in _LOADED:
        _LOADED[path, kind] = PieceEncoder(path, kind)
    return _LOADED[path, kind]
