"""Token ids of whole texts with the ``tokenizers`` library and a bounded cache of its pieces.

A byte-level BPE first cuts a text into pieces (runs of letters, of digits or of other characters,
each with one space before it, contractions, white space) and encodes each piece by itself. Here the
texts of a chunk are cut at once with numpy on their code points; each distinct piece is looked up in
a bounded table by a 64-bit hash or encoded by the library, and the ids of the texts are gathered from
the pieces' ids. They equal those of encoding each text at once (tested); that two pieces of a table of
a million share a hash is to be expected once in 10^13 lookups of new pieces. Only code points whose class all Unicode
versions agree on are cut here; a text with any other is encoded by the library as a whole. Strings
of special tokens inside a text are ordinary text.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

from .common import mix, powers

CUT = re.compile(r"(?<=\S) (?=\S)")
CHUNK = 3 << 19
SPACE, LETTER, NUMBER, OTHER, END, UNKNOWN = range(6)
#: The contractions that the split pattern takes as pieces.
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")


def _classes() -> np.ndarray:
    """Class of each code point below U+2060; UNKNOWN from U+0250 on but for general punctuation."""
    import unicodedata

    table = np.full(0x2060, UNKNOWN, np.uint8)
    for c in (*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F)):
        kind = unicodedata.category(chr(c))[0]
        table[c] = {"L": LETTER, "N": NUMBER}.get(kind, OTHER)
    table[[*range(9, 14), 0x20, 0x85, 0xA0]] = SPACE
    return table


CLASS_OF = _classes()
SCRAMBLED = np.random.default_rng(11).integers(1, 1 << 63, len(CLASS_OF), np.uint64)


def _hashes(codes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of the pieces [start, stop): differences of prefix sums of a polynomial whose
    coefficients are random numbers of the characters."""
    sums = np.empty(len(codes) + 1, np.uint64)
    sums[0] = 0
    np.take(SCRAMBLED, codes, out=sums[1:])
    sums[1:] *= powers("up", len(codes))
    np.cumsum(sums, out=sums)
    return mix((sums[stop] - sums[start]) * powers("down", len(codes))[start])


def piece_starts(chars: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Where pieces begin, as flags. ``cls`` is END at the character that closes each text."""
    n = len(cls)
    run = np.ones(n, bool)
    run[1:] = cls[1:] != cls[:-1]
    start = run.copy()
    # white space before a word: its last character stands alone, or goes to the word if it is a space
    first = np.flatnonzero(run[1:] & (cls[:-1] == SPACE) & (cls[1:] != END)) + 1
    start[first - 1] = True
    start[first[chars[first - 1] == 0x20]] = False
    # contractions, where an apostrophe begins a piece
    a = np.flatnonzero((chars[:-2] == 0x27) & start[:-2] & (cls[1:-1] == LETTER) & run[1:-1])
    one, two = chars[a + 1], chars[a + 2]
    for letters in CONTRACTIONS:
        hit = a[(one == ord(letters[0])) & ((two == ord(letters[1])) if len(letters) > 1 else True)]
        start[hit + 1] = False
        after = hit + 1 + len(letters)
        start[after[cls[after] == LETTER]] = True
    return start


def _ragged(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices [begin, begin + size) of ``flat``, one after the other."""
    upto = np.cumsum(size)
    at = np.repeat(begin - (upto - size), size)
    at += np.arange(len(at))
    return flat[at]


class Run:
    """Pieces' ids in arrays: sorted 64-bit keys and slices of ``flat``."""

    def __init__(self, keys=(), begin=(), size=(), flat=()):
        self.keys = np.asarray(keys, np.uint64)
        self.begin, self.size, self.flat = np.asarray(begin, np.int64), np.asarray(size, np.int64), np.asarray(flat, np.uint32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the sorted ``keys`` are here, their places)."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        here = self.keys[at] == keys
        return here, at[here]

    def with_run(self, other: "Run") -> "Run":
        keys = np.concatenate([self.keys, other.keys])
        order = np.argsort(keys, kind="stable")
        join = lambda x, y: np.concatenate([x, y])[order]
        return Run(keys[order], join(self.begin, other.begin + len(self.flat)), join(self.size, other.size), np.concatenate([self.flat, other.flat]))


class PieceTable:
    """A bounded table of pieces' ids: recent ones are merged into the young run; when that is full it
    becomes the old one, and the old one goes."""

    def __init__(self, limit: int, recent: int = 50_000):
        self.limit, self.most_recent = limit, recent
        self.recent, self.young, self.old = Run(), Run(), Run()

    def ids_of(self, keys: np.ndarray, make) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat, begin, size) for distinct sorted keys; ``make`` gives (ids as bytes, whether to keep them) for places of unknown ones."""
        begin, size, parts, n = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), [], 0
        todo, again = np.arange(len(keys)), None
        for run in (self.young, self.recent, self.old):
            here, at = run.find(keys[todo])
            again = todo[here]
            size[again] = run.size[at]
            begin[again] = n + np.cumsum(size[again]) - size[again]
            parts.append(_ragged(run.flat, run.begin[at], run.size[at]))
            n, todo = n + len(parts[-1]), todo[~here]
        ids, keep = make(todo)
        size[todo] = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begin[todo] = n + np.cumsum(size[todo]) - size[todo]
        flat = np.concatenate([*parts, np.frombuffer(b"".join(ids), "<u4")])
        new = np.sort(np.concatenate([todo[keep], again]))  # ``again``: found in the old run
        own = size[new]
        self.recent = self.recent.with_run(Run(keys[new], np.cumsum(own) - own, own, _ragged(flat, begin[new], own)))
        if len(self.recent.keys) > self.most_recent:
            self.young, self.recent = self.young.with_run(self.recent), Run()
            if len(self.young.keys) > self.limit:
                self.old, self.young = self.young, Run()
        return flat, begin, size


class PieceEncoder:
    def __init__(self, path: str, max_pieces: int = 1_000_000, max_chars: int = 64):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.table, self.max_chars = PieceTable(max_pieces), max_chars

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _chunk(self, texts: list[str]) -> list[bytes]:
        import pandas as pd

        whole = "\0".join(texts) + "\0"
        chars = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        chars = np.minimum(chars, 0x205F)
        cls = CLASS_OF[chars]
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        cls[ends] = END
        odd = np.unique(np.searchsorted(ends, np.flatnonzero(cls == UNKNOWN)))
        start = np.flatnonzero(piece_starts(chars, cls))
        stop = np.append(start[1:], len(chars))
        real = cls[start] != END
        start, stop = start[real], stop[real]
        hashes = _hashes(chars, start, stop)
        codes, keys = pd.factorize(hashes)
        where = np.empty(len(keys), np.int64)
        where[codes[::-1]] = np.arange(len(codes))[::-1]
        order = np.argsort(keys)
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        first, last = start[where[order]], stop[where[order]]

        def make(places: np.ndarray) -> tuple[list[bytes], np.ndarray]:
            ids = self._library([whole[a:z] for a, z in zip(first[places].tolist(), last[places].tolist())])
            return ids, (last - first)[places] <= self.max_chars

        flat, begin, size = self.table.ids_of(keys[order], make)
        del chars, hashes
        codes = place[codes]
        each = size[codes]
        got = _ragged(flat, begin[codes], each)
        upto = np.concatenate([[0], np.cumsum(each)])
        bound = upto[np.searchsorted(start, np.concatenate([[0], ends]), "left")]
        out = [got[a:z].tobytes() for a, z in zip(bound, bound[1:])]
        for k, b in zip(odd, self._library([texts[k] for k in odd])):
            out[k] = b
        return out

    def _long(self, text: str) -> bytes:
        """A text of more than CHUNK characters, in parts cut where a piece begins."""
        out, at = [], 0
        while len(text) - at > CHUNK:
            cut = CUT.search(text, at + CHUNK)
            if cut is None:
                break
            out += self._chunk([text[at: cut.start()]])
            at = cut.start()
        return b"".join(out + self._chunk([text[at:]]))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if not any(len(t) > CHUNK for t in texts):
            return self._chunk(texts) if texts else []
        return [self._long(t) for t in texts]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder per worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def encoded(batches, path: str, end_id: int, chunk_chars: int = CHUNK):
    """(doc_id, ids) of all rows of Arrow batches ``(doc_id, text)``; null text counts as empty; ``end_id`` closes each.

    Texts are gathered over batches until a chunk is full: distinct pieces are looked up once a chunk.
    """
    enc, end = encoder(path), end_id.to_bytes(4, "little")
    keys, texts, size = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            keys.append(key)
            texts.append(text or "")
            size += len(texts[-1])
            if size >= chunk_chars:
                yield from ((k, ids + end) for k, ids in zip(keys, enc.encode(texts)))
                keys, texts, size = [], [], 0
    yield from ((k, ids + end) for k, ids in zip(keys, enc.encode(texts)))
