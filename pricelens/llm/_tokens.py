"""Byte-level BPE ids of whole Arrow string batches by the tokenizers library.

Byte-level BPE merges within the matches of the pre-splitting pattern only, so a text may be cut
wherever no match can span: before one space or line break that stands between two characters
which are no white space, and before a mark that follows a letter or digit. The batch's texts are cut there, equal pieces are encoded once, and the
ids are put together again. Texts with any other white space (runs, other kinds) go whole to the
library.
"""

from __future__ import annotations

import os
from array import array
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker remembers from batch to batch, about.
REMEMBERED = 400_000
#: Bytes of text that are worked on at once (a longer text is worked on alone).
SLICE_BYTES = 1 << 20
#: White space next to white space, or of a kind other than space and line break.
UNSAFE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}][\s\x0b\x1c-\x1f\x{85}\p{Z}]|[\t\r\f\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|^[ \n]|[ \n]$"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Bytes that are letters or digits by themselves, and marks before which a match of letters or digits ends.
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = True
_MARK[[*b"!#$%&()*+,-./:;<=>?@[]^_`{|}~"]] = True


def ragged(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[at[i] : at[i] + size[i]] of all i, end to end."""
    ends = np.cumsum(size)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    step = np.ones(ends[-1], np.int64)
    full = np.flatnonzero(size)
    first = (ends - size)[full]
    step[first] = at[full]
    step[first[1:]] -= at[full[:-1]] + size[full[:-1]] - 1
    return flat[np.cumsum(step)]


def byte_letters() -> dict[int, int]:
    """The letters by which a byte-level vocabulary spells bytes: printable ones themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 0x100 + i for i, b in enumerate(rest)}


@dataclass
class Coder:
    """A vocabulary, loaded once in each Python worker, with the ids of pieces met before."""

    path: str

    def __post_init__(self) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(self.path)
        self.library.encode_special_tokens = True
        self.letters = byte_letters()
        self.matches = regex.compile(PATTERN).findall
        self.line_break = self.whole("\n")[0]
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.ends = array("I"), array("q", [0])

    def whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def learn(self, piece: bytes) -> int:
        text = piece.decode()
        one = text.isalpha() or (text[0] == " " and text[1:].isalpha())
        for match in [text] if one else self.matches(text):
            spelled = match.replace(" ", "\u0120") if match.isascii() else match.encode().decode("latin-1").translate(self.letters)
            self.ids.extend([t.id for t in self.library.model.tokenize(spelled)])
        self.ends.append(len(self.ids))
        at = self.known[piece] = len(self.ends) - 2
        return at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and each text's number of them; none for a null text."""
        texts = pa.concat_arrays([texts.cast(pa.large_string()).fill_null("")])
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        parts, i = [], 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE_BYTES, side="right")) - 1)
            parts.append(self._slice(texts[i:j]))
            i = j
        return (np.concatenate([x for x, _ in parts]), np.concatenate([n for _, n in parts])) if parts else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        unsafe = pc.match_substring_regex(texts, UNSAFE).to_numpy(zero_copy_only=False)
        if not unsafe.any():
            return self._safe(texts)
        flat, size = self._safe(texts.filter(pa.array(~unsafe)))
        odd = [np.array(self.whole(t), np.uint32) for t in texts.filter(pa.array(unsafe)).to_pylist()]
        sizes = np.zeros(len(texts), np.int64)
        sizes[~unsafe], sizes[unsafe] = size, [len(x) for x in odd]
        of_odd = np.repeat(unsafe, sizes)
        out = np.zeros(len(of_odd), np.uint32)
        out[~of_odd], out[of_odd] = flat, np.concatenate(odd)
        return out, sizes

    def _safe(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """encode() of texts whose every white space is one space or line break between others."""
        texts = pa.concat_arrays([texts])
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if not len(texts) or at[0] == at[-1]:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        cut = (raw == 0x20) | (raw == 0x0A)
        letter = _LETTER[raw]
        letter[1:] |= (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
        cut[1:] |= letter[:-1] & _MARK[raw[1:]]
        cut[at[:-1][np.diff(at) > 0]] = True
        cuts = np.flatnonzero(cut)
        # A piece keeps its space; a line break is an id of its own before the piece that follows it.
        breaks = raw[cuts] == 0x0A
        spans = np.empty(2 * len(cuts) + 1, np.int64)
        spans[0:-1:2], spans[1:-2:2], spans[-2:] = cuts + breaks, cuts[1:], len(raw)
        both = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * len(cuts), [None, pa.py_buffer(spans), pa.py_buffer(raw)])
        coded = pc.dictionary_encode(both.take(pa.array(np.arange(0, 2 * len(cuts), 2))))
        if len(self.known) > REMEMBERED:
            self.forget()
        get, learn = self.known.get, self.learn
        slots = np.fromiter((learn(x) if (k := get(x)) is None else k for x in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        ends = np.array(self.ends, np.int64)
        of = slots[coded.indices.to_numpy(zero_copy_only=False)]
        n = ends[of + 1] - ends[of]
        out = ragged(np.array(self.ids, np.uint32), ends[of], n)
        if breaks.any():
            out = np.insert(out, (np.cumsum(n) - n)[breaks], self.line_break)
            n = n + breaks
        total = np.append(0, np.cumsum(n))
        return out, np.diff(total[np.searchsorted(cuts, at)])


@lru_cache(2)
def coder(path: str) -> Coder:
    return Coder(path)
