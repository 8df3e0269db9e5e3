"""Token ids of whole texts with a public word-level BPE tokenizer.

The tokenizer drops white space and never merges across its pieces: letter runs,
digits and symbol runs. So a text's ids are those of its pieces in order. Texts
are cut into pieces with numpy, many at once; the distinct ones are looked up in
a bounded table, and only those seen for the first time run through the merges.
"""

from __future__ import annotations

import re
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import regex

TOKENIZER = "word_bpe_49k.json"
#: The tokenizer's own split pattern, and its special strings.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPECIAL = (b"<|startoftext|>", b"<|endoftext|>")
#: Characters up to here, but for U+0130, are in normal form, and lower case
#: keeps their number: they are cut here as the tokenizer would. A chunk (between
#: ASCII white space) with any other, or with a special string, is a piece.
LATIN = 0x250
_SPACE, _LETTER, _DIGIT, _SYMBOL, _WHOLE = range(5)


def _class(c: str) -> int:
    return _SPACE if regex.match(r"\s", c) else _LETTER if regex.match(r"\p{L}", c) else _DIGIT if regex.match(r"\p{N}", c) else _SYMBOL


_CLASS = np.array([_class(chr(c)) for c in range(LATIN)], dtype=np.uint8)
_BYTE_CLASS = np.append(_CLASS[:128], np.full(128, _SYMBOL, dtype=np.uint8))
#: The bytes for which the model has a character from U+0100 on, in order; it
#: takes the others as they are. A line feed, which no piece has, is left.
_HIDDEN = [*range(33), *range(127, 161), 173]
_REMAPPED = re.compile("[\x00-\x09\x0b-\x20\x7f-\xa0\xad]")


def _model_text(text: bytes) -> str:
    """Lines of pieces as the model's characters."""
    return _REMAPPED.sub(lambda m: chr(256 + _HIDDEN.index(ord(m[0]))), text.decode().lower().encode().decode("latin-1"))


def _cut(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The pieces of all texts, those of ASCII letters in lower case; whether
    each is a chunk taken whole; and how many there are up to each text's end."""
    data = b" ".join(texts) + b"   "
    try:
        data.decode()
    except UnicodeDecodeError:
        texts = [t.decode("utf-8", "replace").encode() for t in texts]
        data = b" ".join(texts) + b"   "
    raw, low = np.frombuffer(data, np.uint8), np.frombuffer(data.lower(), np.uint8)
    kind = _BYTE_CLASS[raw]
    odd = [m.start() for x in SPECIAL if x in data for m in re.finditer(re.escape(x), data)]
    start = np.ones(len(raw), dtype=bool)
    if not data.isascii():
        lead = np.flatnonzero(raw >= 0xC2)
        code = (raw[lead] & 0x1F).astype(np.int32) << 6 | raw[lead + 1] & 0x3F
        other = (raw[lead] >= 0xCA) | (code >= LATIN) | (code == 0x130)
        odd += lead[other].tolist()
        start &= raw & 0xC0 != 0x80
    if odd:
        spaces = np.flatnonzero(kind == _SPACE)
        k = np.unique(np.searchsorted(spaces, odd))
        mark = np.zeros(len(raw), dtype=np.int8)
        mark[np.where(k > 0, spaces[k - 1] + 1, 0)] = 1
        mark[spaces[k]] = -1
        inside = np.cumsum(mark, dtype=np.int8).view(bool)
    if not data.isascii():
        lead, code = lead[~other], code[~other]
        kind[lead] = kind[lead + 1] = _CLASS[code]
    if odd:
        kind[inside] = _WHOLE
        low = np.where(inside, raw, low)
    start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    keep = kind != _SPACE
    start &= keep
    # 's and the like, where the apostrophe does not go on a run of symbols.
    at = np.flatnonzero((raw == 39) & start & (kind == _SYMBOL))
    a, b = low[at + 1], low[at + 2]
    for hit, n in (np.isin(a, list(b"stmd")), 2), (np.isin(a, list(b"rv")) & (b == 101) | (a == 108) & (b == 108), 3):
        start[at[hit] + 1] = False
        start[at[hit] + n] |= kind[at[hit] + n] == _LETTER
    first, body = np.flatnonzero(start), low[keep]
    bounds = np.append(np.flatnonzero(start[keep]), len(body)).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(body)])
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return pieces, kind[first] == _WHOLE, np.searchsorted(first, ends)


class _Cache:
    """Two generations of at most ``most`` entries: what is still in use moves
    to the young one, the old one goes as a whole."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def age(self) -> None:
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}

    def missing(self, keys) -> list:
        """Distinct values of ``keys`` in neither generation; those in the old
        one are now young."""
        out, young, old = [], self.young, self.old
        for k in set(filterfalse(young.__contains__, keys)):
            if (v := old.get(k)) is None:
                out.append(k)
            else:
                young[k] = v
        return out


class Encoder:
    """``encode(texts)``: each text's ids as little-endian uint32 bytes."""

    def __init__(self, path: str, chunks: int = 250_000, pieces: int = 250_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.chunks, self.pieces = _Cache(chunks), _Cache(pieces)

    def _learn_chunks(self, chunks: list[bytes]) -> None:
        for c in chunks:
            ids = self.tokenizer.encode(c.decode(), add_special_tokens=False).ids
            self.chunks.young[c] = np.array(ids, dtype="<u4").tobytes()

    def _learn(self, pieces: list[bytes]) -> None:
        """Ids of new pieces: the tokenizer's other steps are done, so that its
        model has to merge them only."""
        merge, young = self.merge, self.pieces.young
        for lo in range(0, len(pieces), 5000):
            part, ids, cuts = pieces[lo : lo + 5000], [], [0]
            for word in _model_text(b"\n".join(part)).split("\n"):
                ids += [t.id for t in merge(word)]
                cuts.append(4 * len(ids))
            raw = np.array(ids, dtype="<u4").tobytes()
            young.update(zip(part, [raw[a:b] for a, b in zip(cuts, cuts[1:])], strict=True))

    def rest(self) -> None:
        """Forget whole chunks: an idle worker then holds little."""
        self.chunks = _Cache(self.chunks.most)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        self.chunks.age()
        self.pieces.age()
        pieces, whole, ends = _cut(texts)
        if not len(pieces):
            return [b""] * len(texts)
        found = pieces.dictionary_encode()
        keys = found.dictionary.to_pylist()
        if whole.any():
            chosen = np.zeros(len(keys), dtype=bool)
            chosen[found.indices.to_numpy()[whole]] = True
            chosen = chosen.tolist()
            self._learn_chunks(self.chunks.missing([x for x, w in zip(keys, chosen) if w]))
            self._learn(self.pieces.missing([x for x, w in zip(keys, chosen) if not w]))
            ids = [(self.chunks if w else self.pieces).young[x] for x, w in zip(keys, chosen)]
        else:
            self._learn(self.pieces.missing(keys))
            ids = list(map(self.pieces.young.__getitem__, keys))
        row = pa.array(ids, pa.large_binary()).take(found.indices)
        bounds = np.frombuffer(row.buffers()[1], np.int64)[np.append(0, ends)].tolist()
        held = memoryview(row.buffers()[2] or b"")
        return [held[lo:hi].tobytes() for lo, hi in zip(bounds, bounds[1:])]


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str = TOKENIZER) -> Encoder:
    """This process's encoder for a tokenizer file (a path, or the name of one
    of the public ones); it lives as long as the worker."""
    if name not in _ENCODERS:
        import public_tokenizers

        _ENCODERS[name] = Encoder(name if "/" in name else public_tokenizers.path(name))
    return _ENCODERS[name]
