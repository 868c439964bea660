"""Encoding with the tokenizers library, each distinct piece of text once.

A text is cut where the pre-tokenisers in use always cut: before white space that follows something else, and,
if all its letters are plain Latin ones, between a letter or digit and the punctuation after it (where white space
and punctuation are simple, at commas and full stops only). So the pieces' ids, joined, are the text's ids.
Encoded whole are texts in which white space beyond ASCII could meet ASCII white space, and texts that spell out a
special token.
"""

from __future__ import annotations

import os
import re
from itertools import compress
from operator import not_

import numpy as np

#: Pieces with their leading white space: of any text, and of a text in Latin letters.
PIECE = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
LATIN_PIECE = re.compile(rb"[\x20\x09-\x0D]*[A-Za-z0-9\x80-\xFF]+|[\x20\x09-\x0D]*[^\x20\x09-\x0DA-Za-z0-9\x80-\xFF]+[A-Za-z0-9\x80-\xFF]*|[\x20\x09-\x0D]+")
#: The same without white space, for tokenizers that drop it.
LATIN_WORD = re.compile(rb"[A-Za-z0-9\x80-\xFF]+|[^\x20\x09-\x0DA-Za-z0-9\x80-\xFF]+[A-Za-z0-9\x80-\xFF]*")
#: Without U+0130, which in lower case ends in a mark that joins the punctuation after it.
NOT_LATIN = re.compile("[^\x00-\x7F\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F]")
#: White space, and what some regular expressions count as such, beyond ASCII.
WIDE = re.compile("[\x1C-\x1F\x85\xA0\u1680\u180E\u2000-\u200B\u2028\u2029\u202F\u205F\u3000\uFEFF]")
#: ASCII that is not.
PLAIN = bytes(c for c in range(0x80) if not 0x1C <= c <= 0x1F)
#: Distinct pieces that a Python worker remembers, also from one task to the next: the newer half and, until it
#: is full, the half before; a piece of that which comes again is moved, so frequent ones stay.
REMEMBERED = 1_000_000
#: A character that stands alone between pieces; texts that hold it are encoded whole.
LONE = "\x01"
#: Pieces encoded as one string; those whose bytes their tokens' lengths may not show are parted by a special token or,
#: if white space is dropped, by LONE.
TOGETHER = 200
#: All bytes of ASCII characters and of Latin letters from U+00C0 to U+00FF, which normalising leaves as long.
SAME_LENGTH = bytes([*range(0xC0), 0xC3])
WHITE = b" \t\n\x0b\x0c\r"
IS_WHITE = [c in WHITE for c in range(256)]
STOPS = b",."


def _kinds(white: int, rare: int, other: int, stop: int, letter: int) -> bytes:
    """A table for bytes.translate: blanks and line feeds, other white space, punctuation, commas and full stops, letters and digits."""
    letters = {*range(0x80, 0x100), *b"0123456789", *range(65, 91), *range(97, 123)}
    return bytes(letter if c in letters else white if c in b" \n" else rare if c in WHITE else stop if c in STOPS else other for c in range(256))


#: Neighbours that share a bit below GLUED: a stop after punctuation, so no cut; and, where white space counts, longer
#: or rare white space, and a stop after it. GLUED: other punctuation after a letter, where cutting at stops cuts less.
RUN = _kinds(0, 0, 1, 1, 8), _kinds(0, 0, 8, 1, 0)
SPACED = _kinds(3, 4, 1, 1, 8), _kinds(6, 6, 12, 5, 4)
GLUED, SELDOM = 8, 128


def _simple(raw: bytes, kinds: tuple[bytes, bytes]) -> bool:
    """Whether cutting at stops and white space will do: no such neighbours, and GLUED ones once in SELDOM bytes at most."""
    met = np.frombuffer(raw.translate(kinds[0]), np.uint8)[:-1] & np.frombuffer(raw.translate(kinds[1]), np.uint8)[1:]
    most = met.max(initial=0)
    return most == 0 or most == GLUED and np.count_nonzero(met) * SELDOM <= len(raw)


_ENCODERS: dict[str, Encoder] = {}


def forget() -> None:
    """Drop this worker's encoders: what runs next does not encode."""
    _ENCODERS.clear()


class Encoder:
    """Ids of texts as little-endian uint32 bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.before = Tokenizer.from_file(path), {}, {}
        self.drops_white = self.tokenizer.encode(" a\n", add_special_tokens=False).ids == self.tokenizer.encode("a", add_special_tokens=False).ids
        special = {k: t.content for k, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        self.part, self.mark = max(special.items())
        if self.drops_white and len(one := self.tokenizer.encode(LONE, add_special_tokens=False).ids) == 1:
            self.part, self.mark = one[0], f"\n{LONE}\n"  # cheaper than a special token
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None) or "\0"
        self.lengths = np.zeros(max(self.tokenizer.get_vocab().values(), default=0) + 1, np.int64)
        for token, k in self.tokenizer.get_vocab().items():
            self.lengths[k] = len(token.removesuffix(suffix))  # a byte-level token has a character a byte
        sample = " Ein Bär fährt, \u00e0 3 heures; 12 words" if self.drops_white or self.tokenizer.normalizer is None else ""
        ids = self.tokenizer.encode(sample, add_special_tokens=False).ids
        want = len((sample.replace(" ", "") if self.drops_white else sample).encode())
        self.shows = bool(sample) and int(self.lengths[ids].sum()) == want
        self.special = re.compile(b"|".join(re.escape(s.encode()) for s in special.values()), re.IGNORECASE)

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The worker's own encoder for this file."""
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, pieces: list[bytes]) -> None:
        if not self.shows:
            return self._learn_marked(pieces)
        if self.drops_white:
            plain = [p for p in pieces if not p.translate(None, SAME_LENGTH)]
        else:
            plain = [p for p in pieces if IS_WHITE[p[0]] and not IS_WHITE[p[-1]]]
        marked = list(set(pieces).difference(plain)) if len(plain) < len(pieces) else []
        groups = [plain[k : k + TOGETHER] for k in range(0, len(plain), TOGETHER)]
        joined = [(b" " if self.drops_white else b"").join(g).decode("utf-8", "replace") for g in groups]
        for some, got in zip(groups, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(got.ids, "<u4")
            reached, ends = np.cumsum(self.lengths[ids]), np.cumsum(np.fromiter(map(len, some), np.int64, len(some)))
            at = np.searchsorted(reached, ends)
            if not len(ids) or reached[-1] != ends[-1] or (reached[at] != ends).any():
                marked += some
                continue
            raw, at = ids.tobytes(), [0, *(4 * at + 4).tolist()]
            self.known.update(zip(some, map(raw.__getitem__, map(slice, at, at[1:])), strict=False))
        return self._learn_marked(marked)

    def _learn_marked(self, pieces: list[bytes]) -> None:
        groups = [pieces[k : k + TOGETHER] for k in range(0, len(pieces), TOGETHER)]
        mark = self.mark.encode()
        joined = [mark.join(g).decode("utf-8", "replace") for g in groups]
        for some, got in zip(groups, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(got.ids, "<u4")
            ends = [*(4 * np.flatnonzero(ids == self.part)).tolist(), 4 * len(ids)]
            raw, at = ids.tobytes(), 0
            for p, end in zip(some, ends, strict=True):
                self.known[p] = raw[at:end]
                at = end + 4

    def _pieces(self, raw: bytes) -> list[bytes] | None:
        """The pieces of a text, or None if it is to be encoded whole."""
        if LONE.encode() in raw or b"<|" in raw and self.special.search(raw):
            return None
        if not (rest := raw.translate(None, PLAIN)):
            return self._latin(raw.lower() if self.drops_white else raw)
        try:
            raw.decode()
            text = rest.decode()
        except UnicodeDecodeError:
            text = raw.decode("utf-8", "replace")
        if WIDE.search(text):
            return None
        if NOT_LATIN.search(text):
            return raw.split() if self.drops_white else PIECE.findall(raw)
        return self._latin(raw)

    def _latin(self, raw: bytes) -> list[bytes]:
        """The pieces of a text in Latin letters."""
        if self.drops_white:
            return raw.replace(b",", b" ,").replace(b".", b" .").split() if _simple(raw, RUN) else LATIN_WORD.findall(raw)
        if not _simple(raw, SPACED):
            return LATIN_PIECE.findall(raw)
        cut = LONE.encode()
        for c in (b" ", b"\n", b",", b"."):
            raw = raw.replace(c, cut + c)
        pieces = raw.split(cut)
        if not pieces[0]:
            del pieces[0]
        return pieces

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        cut = [self._pieces(raw) for raw in texts]
        known, before = self.known, self.before
        found = [list(map(known.get, pieces or ())) for pieces in cut]
        gaps = [list(compress(range(len(ids)), map(not_, ids))) for ids in found]
        new = {pieces[k] for pieces, places in zip(cut, gaps, strict=True) for k in places}
        if len(known) + len(new) > REMEMBERED // 2:  # what is found stays so
            before, known = known, {}
            self.known, self.before = known, before
        lacking = []
        for p in new:
            if (ids := before.get(p)) is None:
                lacking.append(p)
            else:
                known[p] = ids
        self._learn(lacking)
        for pieces, ids, places in zip(cut, found, gaps, strict=True):
            for k in places:
                ids[k] = known[pieces[k]]
        return [self._whole(raw.decode("utf-8", "replace")) if pieces is None else b"".join(ids) for raw, pieces, ids in zip(texts, cut, found, strict=True)]
