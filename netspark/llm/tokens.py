"""BPE encoding and decoding that agree with the ``tokenizers`` library, piece by piece.

A byte-level BPE first splits a text into pieces (words with their leading space, digit runs, punctuation runs,
white space) and merges inside each piece only, so a text's ids are its pieces' ids in a row.  ``PieceEncoder`` asks
the library for the ids of each *distinct* piece and keeps them in a bounded memo.

Pieces that no rule splits can be arbitrarily long.  Those are encoded by **tree concatenation**: shares of the leaves
are encoded side by side by ``THREADS`` threads (the library works outside the interpreter's lock), and neighbours are
joined pairwise up a tree, the joins of one level side by side, too.  At a join
a window of tokens on either side is encoded anew, and the window grows until its first token equals the left side's
and its last token the right side's.  A BPE token sequence is the encoding of its text exactly when each two
neighbouring tokens are, so agreement at both rims makes the joined sequence the exact encoding.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import suppress
from functools import cached_property, lru_cache
from typing import TYPE_CHECKING

import numpy as np

if TYPE_CHECKING:
    from tokenizers import Tokenizer

#: The splitting rule of the byte-level vocabulary, restricted to characters on whose class every Unicode version agrees.
_L = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_N = "0-9²³¹¼-¾"
_OTHER = re.compile("[^\t\n\r\x20-\x7e¡-¬®-ÿ‐-‧]")
#: Letters and digits come first, as no contraction begins with one, and nothing is given back.
_BYTE_PIECES = re.compile(rf" ?+(?:[{_L}]++|[{_N}]++)|'(?:s|t|re|ve|m|ll|d)| ?[^\s{_L}{_N}]++|\s+(?!\S)|\s+")
_SAFE = bytes([9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)])
_WORD_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+")

#: Characters from which a piece counts as long unsplit text, tokens in the first window at a join, pieces kept.
LONG, LEAF, WINDOW, MEMO, THREADS = 1024, 512, 4, 400_000, 2


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary file ``name`` lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of_char() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies, reversed."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _plain(text: str) -> bool:
    """Whether the rules above split ``text`` as the library does."""
    if "<|" in text:
        return False
    try:
        return not text.encode("latin-1").translate(None, _SAFE)
    except UnicodeEncodeError:
        return _OTHER.search(text) is None


def _gaps(found: list) -> Iterator[int]:
    """Places of None."""
    i = -1
    with suppress(ValueError):
        while True:
            i = found.index(None, i + 1)
            yield i


class PieceEncoder(dict):
    """Memo from piece to its ids as little-endian unsigned 32-bit integers.

    ``lower``: the vocabulary lower-cases and drops white space (word pieces) instead of keeping every byte.
    """

    def __init__(self, path: str, lower: bool = False, long: int = LONG, leaf: int = LEAF, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = os.environ.get("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.lower, self.long, self.leaf, self.memo = bool(lower), long, leaf, memo
        special = sorted((t.content for t in self.tok.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.pieces = (_WORD_PIECES if lower else _BYTE_PIECES).findall
        self.old: dict[str, bytes] = {}

    def _turn(self, more: int) -> None:
        """Two generations: what was not used since the last turn goes."""
        if len(self) + more > self.memo:
            self.old = dict(self)
            self.clear()

    def rest(self) -> None:
        """At a task's end: the older generation goes, so that idle workers hold little."""
        self.old = {}

    def learn(self, pieces: set[str]) -> None:
        """Adds the ids of pieces that are not in the memo, in one call of the library."""
        self._turn(len(pieces))
        if self.old:
            known = {p: ids for p in pieces if (ids := self.old.get(p)) is not None}
            self.update(known)
            pieces = pieces - known.keys()  # as many as were asked for, at most
        # pieces that stay apart when written in a row go to the library in rows, cut apart again where a piece's bytes
        # (or its end mark) end
        if self.lower:
            words, rest = list(pieces), []
        else:
            words = [p for p in pieces if p[0] == " " and not p.isspace() and len(p) < self.long]
            rest = pieces.difference(words)
        for k in range(0, len(words), 512):
            row = words[k : k + 512]
            line = " ".join(row) if self.lower else "".join(row).encode().decode("latin-1").translate(self.shown)
            ids = np.array(self.in_rows.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
            if self.lower:
                ends = np.flatnonzero(self.closes[ids]) + 1
            else:
                at = np.cumsum([len(p.encode()) for p in row])
                made = np.cumsum(self.n_bytes[ids])
                ends = np.searchsorted(made, at) + 1
                if made[ends - 1].tolist() != at.tolist():
                    raise ValueError("the vocabulary merges across words")
            if len(ends) != len(row) or (len(row) and ends[-1] != len(ids)):
                raise ValueError("the vocabulary merges across words")
            packed, e = ids.tobytes(), (4 * ends).tolist()
            self.update(zip(row, [packed[i:j] for i, j in zip([0, *e], e)]))
        rest = [p for p in rest if len(p) < self.long]
        for p, x in zip(rest, self.tok.encode_batch_fast(rest, add_special_tokens=False)):
            self[p] = array("I", x.ids).tobytes()

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """``encode`` of each text; the new pieces of all of them go to the library together."""
        split = [self.pieces(t.lower() if self.lower else t) if t and _plain(t) else None for t in texts]
        found = [None if p is None else list(map(self.get, p)) for p in split]
        gaps = [list(_gaps(f)) if f else () for f in found]
        if new := {p[i] for p, g in zip(split, gaps) for i in g}:
            self.learn(new)
            for p, f, g in zip(split, found, gaps):
                for i in g:
                    f[i] = self[p[i]]
        return [self.encode(t) if f is None else b"".join(f) for f, t in zip(found, texts)]

    def __missing__(self, piece: str) -> bytes:
        if piece in self.old:
            return self.old[piece]
        self._turn(1)
        if len(piece) >= self.long and not self.lower:
            return np.asarray(self.tree(piece), "<u4").tobytes()
        ids = array("I", self.tok.encode(piece, add_special_tokens=False).ids).tobytes()
        self[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text, packed; null counts as empty."""
        if not text:
            return b""
        if _plain(text):
            return b"".join(map(self.__getitem__, self.pieces(text.lower() if self.lower else text)))
        if self.lower:  # normalisation may cross pieces: the library takes the whole text
            return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()
        out = []
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                out.append(np.uint32(self.tok.token_to_id(part)).tobytes())
            elif part:
                out += [self[part[a:b]] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(part)]
        return b"".join(out)

    @cached_property
    def in_rows(self) -> Tokenizer:
        """The library for rows of words; a byte-level one takes them as ``shown`` and only cuts at white space."""
        if self.lower:
            return self.tok
        from tokenizers import Tokenizer, pre_tokenizers

        tok = Tokenizer.from_str(self.tok.to_str())
        tok.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        return tok

    @cached_property
    def shown(self) -> dict[int, str]:
        """For ``str.translate`` of bytes read as Latin-1: each byte's stand-in, white space before that of a space."""
        return {b: " " * (b == 32) + c for c, b in _byte_of_char().items()}

    # ---- decoding

    @cached_property
    def n_bytes(self) -> np.ndarray:
        """Bytes of every id of a byte-level vocabulary."""
        return np.array([len(t) for t in self.token_bytes], np.int64)

    @cached_property
    def closes(self) -> np.ndarray:
        """Whether an id ends a word."""
        return np.array([(self.tok.id_to_token(i) or "").endswith("</w>") for i in range(self.tok.get_vocab_size())])

    @cached_property
    def token_bytes(self) -> list[bytes]:
        """The bytes of every id of a byte-level vocabulary."""
        back = _byte_of_char()
        names = [self.tok.id_to_token(i) or "" for i in range(self.tok.get_vocab_size(with_added_tokens=True))]
        return [bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t in names]

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text that the ids stand for; broken sequences become U+FFFD as in the library."""
        raw = b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode("utf-8", "replace").encode()

    # ---- long unsplit text

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def tree(self, piece: str) -> list[int]:
        """Ids of one unsplit piece by tree concatenation."""
        leaves = [piece[i : i + self.leaf] for i in range(0, len(piece), self.leaf)]
        size = -(-len(leaves) // THREADS)
        with ThreadPoolExecutor(THREADS) as pool:
            shares = pool.map(self._whole, [leaves[i : i + size] for i in range(0, len(leaves), size)])
            sides = [ids for share in shares for ids in share]
            while len(sides) > 1:
                joined = list(pool.map(self.join, sides[::2], sides[1::2]))
                sides = joined + ([sides[-1]] if len(sides) % 2 else [])
        return sides[0]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """One exact encoding from those of two neighbouring halves."""
        table, w = self.token_bytes, WINDOW
        while True:
            a, b = max(0, len(left) - w), min(len(right), w)
            # a window starts and ends between characters
            while a > 0 and table[left[a]] and table[left[a]][0] & 0xC0 == 0x80:
                a -= 1
            while b < len(right) and table[right[b]] and table[right[b]][0] & 0xC0 == 0x80:
                b += 1
            mid = self._whole([b"".join(table[i] for i in [*left[a:], *right[:b]]).decode()])[0]
            if (a == 0 or mid[0] == left[a]) and (b == len(right) or mid[-1] == right[b - 1]):
                return left[:a] + mid + right[b:]
            w *= 2


@lru_cache(2)
def shared_encoder(path: str, lower: bool = False) -> PieceEncoder:
    """One encoder a Python worker: its memo serves all tasks that the worker gets."""
    return PieceEncoder(path, lower)
