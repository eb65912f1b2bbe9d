"""Byte-level BPE encoding and decoding.

Encoder: an Aho-Corasick automaton over the vocabulary gives the longest token at every place of a
piece. Tokens are laid down greedily; a token may follow another only if the pair is compatible,
that is, if merging the two tokens' bytes by rank ends in just these two. Where no compatible token
fits, the encoder goes back by one token and tries its next shorter prefix; places known as dead
ends are never tried again, so each place is left for good at most once and the work is linear in
the piece. The result is what applying merges by rank gives.

Decoder: the tokens' bytes stand in one buffer, and an offset table tells where each begins.

Texts are cut into pieces by the pattern of byte-level BPE before; strings of special tokens found
in a text become their ids, as the tokenizers library does by default. Equal pieces repeat, so the
encoded pieces are kept in a bounded table; a long piece is encoded each time.
"""

from __future__ import annotations

import functools
import json
import re
import struct
from collections.abc import Callable

import ahocorasick
import numpy as np
import regex

#: Pieces that are kept in each of two generations, and the length over which they are not.
KEPT_PIECES, KEPT_CHARS = 300_000, 64

#: The pattern of byte-level BPE, and the same with its classes spelt out for texts below U+0250.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LETTERS, NUMBERS, SPACES = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
LATIN_PIECES = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"

_beyond_latin = re.compile("[^\x00-ɏ]").search
_latin_pieces = re.compile(LATIN_PIECES).findall
_any_pieces = regex.compile(PIECES.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"(?!\S)", r"(?!\P{White_Space})")).findall


def pieces(text: str) -> list[str]:
    return (_any_pieces if _beyond_latin(text) else _latin_pieces)(text)


@functools.cache
def byte_letters() -> tuple[str, ...]:
    """For each byte the letter that stands for it in byte-level vocabularies: itself if it prints, else from U+0100 on."""
    prints = [33 <= b <= 126 or 161 <= b <= 172 or b >= 174 for b in range(256)]
    others = iter(range(256, 512))
    return tuple(chr(b) if prints[b] else chr(next(others)) for b in range(256))


@functools.cache
def letter_table() -> dict[int, str]:
    return dict(enumerate(byte_letters()))


def spelt(piece: str) -> str:
    """The letters of a piece's bytes."""
    if piece.isascii() and piece.isprintable():
        return piece.replace(" ", byte_letters()[32])
    return piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(letter_table())


class Vocabulary:
    """Tokens, merges and special tokens of a tokenizer file, with what the encoder and decoder need."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = byte_letters()
        ids: dict[str, int] = data["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for r, m in enumerate(data["model"]["merges"]):
            left, right = m if isinstance(m, list) else m.split(" ")
            pair, whole = (ids[left], ids[right]), ids[left + right]
            self.rank.setdefault(pair, r)
            self.made.setdefault(pair, whole)
            self.parts.setdefault(whole, pair)
        self.length = {i: len(s) for s, i in ids.items()}
        self.automaton = ahocorasick.Automaton()
        for s, i in ids.items():
            self.automaton.add_word(s, (i, len(s)))
        self.shorter = {i: ids[s[:n]] if (n := next((n for n in range(len(s) - 1, 0, -1) if s[:n] in ids), 0)) else -1 for s, i in ids.items()}
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}

        byte_of = {c: b for b, c in enumerate(letters)}
        whole = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for s, i in ids.items():
            whole[i] = bytes(byte_of[c] for c in s)
        for s, i in self.special.items():
            whole[i] = s.encode()
        self.offsets = np.concatenate([[0], np.cumsum([len(b) for b in whole])]).astype(np.int64)
        self.buffer = np.frombuffer(b"".join(whole), np.uint8)

    def compatible(self, a: int, b: int) -> bool:
        """If merging the bytes of a and b by rank keeps the border between them to the end."""
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            known = self.fits[a, b] = self._border_holds(a, b)
        return known

    def _border_holds(self, a: int, b: int) -> bool:
        """Undo merges from the last one on, on the side that was merged later. Two tokens at the
        border stood side by side until the first of the merges that took one of them away; a merge
        of the two with a smaller rank would have come before it. At equal ranks the left merge of
        the two comes first."""
        never = len(self.rank)
        until_a = until_b = never
        while True:
            r = self.rank.get((a, b), never)
            if r < until_a and r <= until_b and r < never:
                return False
            of_a, of_b = (self.rank[self.parts[x]] if x in self.parts else -1 for x in (a, b))
            if of_a < 0 and of_b < 0:
                return True
            if of_a > of_b:
                until_a, a = of_a, self.parts[a][1]
            else:
                until_b, b = of_b, self.parts[b][0]

    def longest_from(self, letters: str) -> list[int]:
        """For each place, the longest token that begins there."""
        best, size = [-1] * len(letters), [0] * len(letters)
        for end, (i, n) in self.automaton.iter(letters):
            at = end - n + 1
            if n > size[at]:
                best[at], size[at] = i, n
        return best

    def encode_piece(self, piece: str) -> list[int]:
        letters = spelt(piece)
        longest, length, n = self.longest_from(letters), self.length, len(letters)
        out: list[int] = []
        alive = bytearray(b"\x01") * (n + 1)
        at, token = 0, longest[0] if n else -1
        while at < n:
            while token >= 0 and not (alive[at + length[token]] and (not out or self.compatible(out[-1], token))):
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                token = longest[at] if at < n else -1
            else:
                alive[at] = 0
                token = out.pop()
                at -= length[token]
                token = self.shorter[token]
        return out

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        first = self.offsets[ids]
        size = self.offsets[ids + 1] - first
        ends = np.cumsum(size)
        if not len(ends):
            return b""
        return self.buffer[np.repeat(first - ends + size, size) + np.arange(ends[-1])].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


class PieceTable(dict):
    """Pieces to their ids as little-endian unsigned 32-bit integers. Two generations bound it: when the new one
    is full, it becomes the old one, whose pieces come back as they are met again."""

    def __init__(self, encode: Callable[[str], list[int]], special: dict[str, int], split: Callable[[str], list[str]] | None) -> None:
        super().__init__()
        self.encode, self.split, self.marks = encode, split, {k: np.uint32(i).tobytes() for k, i in special.items()}
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece)
        if out is None:
            ids = self.encode(piece)
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= KEPT_CHARS:
            if len(self) >= KEPT_PIECES:
                self.old = dict(self)
                self.clear()
            self[piece] = out
        return out

    def ids(self, text: str) -> bytes:
        """The ids of a whole text, 4 bytes each."""
        if self.split and any(m in text for m in self.marks):
            return b"".join(self.marks[p] if p in self.marks else b"".join(map(self.__getitem__, pieces(p))) for p in self.split(text))
        return b"".join(map(self.__getitem__, pieces(text)))


@functools.lru_cache(1)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@functools.lru_cache(1)
def own_encoder(path: str) -> PieceTable:
    """Encodes by the backtracking encoder of this module."""
    v = vocabulary(path)
    return PieceTable(v.encode_piece, v.special, v.split_special)


@functools.lru_cache(1)
def library_encoder(path: str) -> PieceTable:
    """Encodes each piece by the BPE model of the tokenizers library."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model = tokenizer.model
    special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
    split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")").split if special else None
    return PieceTable(lambda piece: [t.id for t in model.tokenize(spelt(piece))], special, split)
