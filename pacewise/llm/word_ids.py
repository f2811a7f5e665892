"""Ids of the public word-BPE tokenizer, each distinct word encoded once per worker and remembered.

The tokenizer drops white space and treats the pre-tokens between it apart, so a
text's ids are its words' ids in order. ``TextIds`` splits texts at ASCII white
space, finds the distinct words of a slice of texts, and encodes only those that
the worker has not met. The memory for words is bounded; it starts anew when full.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters for which lower-casing and letter classes are the same everywhere: printable ASCII, Latin-1 letters.
PLAIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
#: The tokenizer's pre-token pattern, restricted to those characters.
PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
REMEMBERED = 200_000
SLICE_BYTES = 2 << 20


def _byte_letters() -> dict[int, str]:
    """Latin-1 letters as byte-level BPE spells their UTF-8 bytes (printable bytes are themselves)."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    spelled = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return {c: "".join(spelled[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


@functools.cache
def text_ids(path: str) -> TextIds:
    """The encoder of this Python worker, which keeps the words it knows from task to task."""
    return TextIds(path)


class TextIds:
    """Encodes texts with the tokenizer file at ``path``."""

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.remembered = self.tokenizer.model, remembered
        self.letters, self.words, self.parts = _byte_letters(), {}, {}
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(added) or r"(?!)")

    def part(self, pre_token: str) -> bytes:
        found = self.parts.get(pre_token)
        if found is None:
            spelled = pre_token if pre_token.isascii() else pre_token.translate(self.letters)
            found = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
            if len(self.parts) >= self.remembered:
                self.parts.clear()
            self.parts[pre_token] = found
        return found

    def word(self, word: str) -> bytes:
        """The ids of one word as uint32; words out of the ordinary take the whole tokenizer."""
        if PLAIN.fullmatch(word) and not self.special.search(word):
            low = word.lower()
            found = self.part(low) if low.isalpha() else b"".join(map(self.part, PRE_TOKEN.findall(low)))
        else:
            found = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        if len(self.words) >= self.remembered:
            self.words.clear()
        self.words[word] = found
        return found

    def slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, each text's end in them)."""
        words = pc.ascii_split_whitespace(texts)
        flat = words.flatten().dictionary_encode()
        met = self.words.get
        known = [met(w) or self.word(w) for w in flat.dictionary.to_pylist()]
        size = np.fromiter((len(k) // 4 for k in known), dtype=np.int64, count=len(known))
        start = np.cumsum(size) - size
        pool = np.frombuffer(b"".join(known), dtype="<u4")
        which = flat.indices.to_numpy(zero_copy_only=False)
        length = size[which]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        ids = pool[np.repeat(start[which] - (ends - length), length) + np.arange(total)] if total else pool[:0]
        last = words.offsets.to_numpy()[1:] - words.offsets.to_numpy()[0]
        return ids, np.concatenate([[0], ends])[last]

    def texts(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text in turn, a slice of some megabytes at a time; a null text has none."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        size = pc.binary_length(column).to_numpy(zero_copy_only=False)
        block = np.cumsum(size) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(column)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            ids, ends = self.slice(column.slice(a, b - a))
            yield from np.split(ids, ends[:-1]) if b > a else ()
