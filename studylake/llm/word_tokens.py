"""Token ids of whole texts by a vocabulary file of the tokenizers library.

The library spends most of its time on words that it has met before.  Here a
text is cut where its pre-tokenizer always cuts, distinct pieces are encoded
once by the library and kept, and a text's ids are put together by numpy.  A
text in which those cuts aren't certain, such as one that holds a special
token's own string, goes to the library whole, so ids are always those of
``Tokenizer.encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import os
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import SparkSession

#: Pieces that one worker keeps before it starts anew.
KEPT_PIECES = 800_000
#: Pieces that the library gets as one text.
PIECES_PER_TEXT = 1000
#: Pieces of no word: a blank or line feed that ends its text.
_BARE = ("", "\n")
#: White space of Unicode.
_SPACE = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _class(characters: str) -> str:
    return "[" + "".join(rf"\x{{{ord(c):x}}}" for c in characters) + "]"


#: Runs of white space, or white space other than blank and line feed (in RE2's grammar).
_ODD_SPACE = f"{_class(_SPACE)}{{2}}|{_class(_SPACE.replace(' ', '').replace(chr(10), ''))}"


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _marked(piece: str) -> bool:
    """Whether a comma or full stop ends the piece after an ASCII letter, which no normalisation changes."""
    return piece[-1:] in (",", ".") and piece[-2:-1].isalpha() and piece[-2:-1].isascii()


def _stretches(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of stretches, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(sizes.sum())


class _Pieces(dict):
    """Piece -> number; pieces not met before are numbered and noted."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        self.fresh.append(piece)
        return number


class WordEncoder:
    """Encodes texts by their pieces.

    byte_level: the vocabulary keeps white space (a blank belongs to the next
    word); otherwise white space only separates words.
    """

    def __init__(self, path: str, byte_level: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.byte_level = byte_level
        self.marks = {m: self.library.encode("a" + m, add_special_tokens=False).ids[1:] for m in ",."}
        #: Of a byte-level vocabulary: whether an id begins with a blank or line feed (as its file writes them).
        tokens = self.library.get_vocab()
        self.opens = np.zeros(max(tokens.values(), default=0) + 1, bool)
        self.opens[[i for t, i in tokens.items() if t[:1] in ("\u0120", "\u010a")]] = True
        self._clear()

    def _clear(self) -> None:
        self.pieces = _Pieces()
        self.flat = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1, np.int64)
        # Learned apart, before any other: after them no cut is certain.
        for piece in _BARE:
            self.pieces[piece]
        self._learn()

    def _learn(self) -> None:
        fresh = self.pieces.fresh
        if not fresh:
            return
        # A comma or full stop after a letter is cut off by either pre-tokenizer: the word
        # before it is encoded once, with it or without.
        ended = [p for p in fresh if _marked(p)]
        words = np.fromiter((self.pieces[p[:-1]] for p in ended), np.int64, len(ended))
        marked = np.zeros(len(fresh), bool)
        marked[np.fromiter(map(self.pieces.__getitem__, ended), np.int64, len(ended)) - (len(self.ends) - 1)] = True
        found, sizes = self._ask([p for p, m in zip(fresh, marked.tolist(), strict=True) if not m])
        marks = [self.marks[p[-1]] for p in ended]
        more = np.fromiter(map(len, marks), np.int64, len(ended))
        lengths = np.zeros(len(fresh), np.int64)
        lengths[~marked] = sizes
        of_words = np.concatenate([np.diff(self.ends), lengths])[words]
        lengths[marked] = of_words + more
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])
        while self.ends[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        begins = self.ends[-len(fresh) - 1 : -1]
        self.flat[_stretches(begins[~marked], sizes)] = found
        self.flat[_stretches(begins[marked], of_words)] = self.flat[_stretches(self.ends[words], of_words)]
        self.flat[_stretches(begins[marked] + of_words, more)] = np.fromiter(chain.from_iterable(marks), np.uint32)
        fresh.clear()

    def _ask(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of pieces, one after the other, and how many each has.

        Byte-level pieces are joined as they would stand in a text, which costs one
        call for many: each begins with the id of a blank or line feed and holds no other.
        """
        # A piece stands for itself after a blank, or begins with the line feed before it.
        asked = [p if p[:1] == "\n" else " " + p for p in pieces] if self.byte_level else pieces
        if self.byte_level and not any(p in _BARE for p in pieces):
            flat = self._flat("".join(asked[i : i + PIECES_PER_TEXT]) for i in range(0, len(asked), PIECES_PER_TEXT))[0]
            at = np.flatnonzero(self.opens[flat])
            if len(at) == len(pieces):
                return flat, np.diff(np.append(at, len(flat)))
        return self._flat(asked)

    def _flat(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.library.encode_batch_fast(list(texts), add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.pieces) > KEPT_PIECES:
            self._clear()
        odd = pc.match_substring_regex(pa.array(texts, pa.large_string()), _ODD_SPACE).to_pylist() if self.byte_level else [False] * len(texts)
        out: list = [None] * len(texts)
        numbers, counts, at = [], [], []
        for i, text in enumerate(texts):
            if not text:
                out[i] = np.zeros(0, np.uint32)
            elif any(s in text for s in self.special) or (self.byte_level and (text[0] in " \n" or odd[i])):
                out[i] = np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
            elif self.byte_level:
                # The line feed put before the text is one id, dropped below.
                words = ("\n" + text).replace("\n", " \n")[1:].split(" ")
            else:
                words = text.replace("\n", " ").split(" ")
            if out[i] is None:
                numbers.append(np.fromiter(map(self.pieces.__getitem__, words), np.int64, len(words)))
                counts.append(len(words))
                at.append(i)
        self._learn()
        if not at:
            return out
        pick = np.concatenate(numbers)
        lengths = np.diff(self.ends)[pick]
        before = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.flat[_stretches(self.ends[pick], lengths)]
        cuts = before[np.concatenate([[0], np.cumsum(counts)])]
        skip = 1 if self.byte_level else 0
        for i, a, b in zip(at, cuts[:-1], cuts[1:], strict=True):
            out[i] = ids[a + skip : b]
        return out


class KeptEncoder:
    """A worker's encoder of a vocabulary file (a public name or a path), built at its first text."""

    def __init__(self, name: str, byte_level: bool):
        self.name, self.byte_level = name, byte_level
        self.built: WordEncoder | None = None

    def __getstate__(self):
        return self.name, self.byte_level

    def __setstate__(self, state):
        self.__init__(*state)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.built is None:
            path = self.name if os.path.isabs(self.name) else vocabulary(self.name)
            self.built = WordEncoder(path, self.byte_level)
        return self.built.encode(texts)


def shared_encoder(spark: SparkSession, name: str, byte_level: bool) -> Broadcast:
    """An encoder for all tasks of a query: as a broadcast value it goes, with its pieces, once a worker does other work."""
    return spark.sparkContext.broadcast(KeptEncoder(name, byte_level))
