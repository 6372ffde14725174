"""Token ids of whole texts by a public tokenizer, with a memory for words.

The tokenizers library needs microseconds per word, most of them for words it has
met before. Both kinds of tokenizer used here look at a text in stretches that never
reach over ASCII blanks, so the ids of a text are those of its stretches, one after
the other. Each stretch is tokenized once and remembered, up to a number of
stretches. A stretch of plain Latin letters is one word to both kinds, so the
library's model gets it directly, in the byte alphabet it expects; all others go
through the whole library. A text with blanks outside ASCII, or with what may be the
string of an added token such as an end mark, is a stretch by itself and is not
remembered.
"""

from __future__ import annotations

import itertools
import re
import zlib
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

#: Stretches remembered by one worker, and characters of them; twice as many while the
#: older half ages. Twice that where texts are split by Arrow, which needs less beside it.
REMEMBERED, REMEMBERED_CHARACTERS = 300_000, 32 << 20
#: Stretches given to the library at once.
AT_ONCE = 20_000

# Blanks, or characters that some library counts as such, other than the ASCII six.
_ODD_BLANKS = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -‏ -  -⁠　﻿]")
# Letters that no normalizer here changes other than by lower-casing them, where a
# blank, the end, or a mark follows that no tokenizer takes together with letters.
_LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
_MARKS = '.,;:!?|%$&*#@/()"-'
_ALONE = rf"{_LETTERS}(?=[ \t-\r{_MARKS}]|\Z)"
_WITHOUT_BLANKS = re.compile(rf"{_ALONE}|[^ \t-\r]+")
# Blanks go with the word after them: one space, at most, joins it.
_WITH_BLANKS = re.compile(
    rf" ?{_ALONE}| ?[^ \t-\r]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"
)

_PLAIN = re.compile(f" ?{_LETTERS}")
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}


def _byte_alphabet() -> dict[int, int]:
    """Byte-level tokenizers write every byte as a visible character: itself, or the
    next one from 256 on."""
    hidden = [b for b in range(256) if b not in _SHOWN]
    return {b: 256 + i for i, b in enumerate(hidden)}


_ALPHABET = _byte_alphabet()
_loaded: dict[str, Encoder] = {}


class Encoder:
    """Ids of texts, as little-endian numbers of ``width`` bytes."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        # What marks a text that may hold an added token: its string or, where the
        # normalizer may make it of other letters, the longest stretch without any.
        self.marks = {
            max(re.split(r"[^\W\d_]+", t.content), key=len) if t.normalized else t.content
            for t in self.library.get_added_tokens_decoder().values()
        }
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        # Byte-level without a normalizer keeps blanks; the other kind drops them.
        keeps = self.library.normalizer is None and isinstance(
            self.library.pre_tokenizer, ByteLevel
        )
        self.stretches = (_WITH_BLANKS if keeps else _WITHOUT_BLANKS).findall
        self.encode_cut = self._by_stretches if keeps else self._by_words
        self.room = 1 if keeps else 2
        self.model = self.library.model
        self.lowers = self.library.normalizer is not None
        self.kind = "H" if self.width == 2 else "I"
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.characters = 0

    def _encode_plain(self, word: str) -> bytes:
        """A word of plain letters, perhaps after a space: the model's ids of it."""
        if self.lowers:
            word = word.lower()
        if word.isascii():
            shown = word.replace(" ", chr(_ALPHABET[0x20]))
        else:
            shown = word.encode().decode("latin-1").translate(_ALPHABET)
        return array(self.kind, [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _encode(self, texts: list[str]) -> list[bytes]:
        kind = f"<u{self.width}"
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=kind).tobytes() for e in found]

    def _learn(self, new: set[str]) -> None:
        remembered = [w for w in new if w in self.older]
        self.known.update((w, self.older[w]) for w in remembered)
        rest = []
        for w in new.difference(remembered):
            if _PLAIN.fullmatch(w):
                self.known[w] = self._encode_plain(w)
            else:
                rest.append(w)
        for i in range(0, len(rest), AT_ONCE):
            part = rest[i : i + AT_ONCE]
            self.known.update(zip(part, self._encode(part), strict=True))

    def _remember(self, met: set[str]) -> None:
        if new := met.difference(self.known):
            self._learn(new)
            self.characters += sum(map(len, new))

    def _by_stretches(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that are cut everywhere, each stretch looked up by itself."""
        cut = [self.stretches(t) for t in texts]
        self._remember(set().union(*cut))
        return [b"".join(map(self.known.__getitem__, own)) for own in cut]

    def _by_words(self, texts: list[str]) -> list[bytes]:
        """The same where blanks have no ids: Arrow splits the texts at blanks, only the
        different words are looked up, and Arrow puts their ids in a row again."""
        words = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        met = words.values.dictionary_encode()
        different = met.dictionary.to_numpy(zero_copy_only=False).tolist()
        placed = pa.array(self._ids_of_words(different), pa.large_binary()).take(met.indices)
        if not len(placed):
            return [b""] * len(texts)
        _, offsets, data = placed.buffers()
        bounds = np.frombuffer(offsets, "<i8")[words.offsets.to_numpy()].tolist()
        rows = memoryview(data or b"")
        return [bytes(rows[a:b]) for a, b in itertools.pairwise(bounds)]

    def _ids_of_words(self, words: list[str]) -> list[bytes]:
        """Ids of different words without blanks; marks after one are no part of it."""
        known, older, is_plain = self.known, self.older, _PLAIN.fullmatch
        ids = list(map(known.get, words))
        rest, learned = [], 0
        for k in [k for k, own in enumerate(ids) if own is None]:
            word = letters = words[k]
            if (own := older.get(word)) is None:
                letters = word.rstrip(_MARKS)
                if not is_plain(letters):
                    rest.append(k)
                    continue
                if (own := known.get(letters)) is None and (own := older.get(letters)) is None:
                    own = self._encode_plain(letters)
            if letters not in known:
                known[letters] = own
                learned += len(letters)
            if len(letters) == len(word):
                ids[k] = own
            elif (end := known.get(word[len(letters) :])) is not None:
                ids[k] = own + end
            else:
                rest.append(k)
        self.characters += learned
        cut = [self.stretches(words[k]) for k in rest]
        self._remember(set().union(*cut))
        for k, own in zip(rest, cut, strict=True):
            ids[k] = b"".join(map(known.__getitem__, own))
        return ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; none for a missing or empty one."""
        full = len(self.known) > self.room * REMEMBERED
        if full or self.characters > self.room * REMEMBERED_CHARACTERS:
            self.older, self.known, self.characters = self.known, {}, 0
        out, cut = [b""] * len(texts), []
        for i, text in enumerate(texts):
            if not text:
                continue
            if any(m in text for m in self.marks) or _ODD_BLANKS.search(text):
                out[i] = self._encode([text])[0]
            else:
                cut.append(i)
        for i, data in zip(cut, self.encode_cut([texts[i] for i in cut]), strict=True):
            out[i] = data
        return out

    def ids(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, f"<u{self.width}")


def encoder(name: str) -> Encoder:
    """The encoder of a tokenizer file; each worker loads it once.

    ``name``: a path, or the name of a file among the public tokenizers."""
    if name not in _loaded:
        _loaded[name] = Encoder(name if "/" in name else str(public_tokenizers.path(name)))
    return _loaded[name]


def crc32_of_ids(ids: np.ndarray) -> int:
    """CRC-32 of the ids as little-endian unsigned 32-bit numbers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
