"""Token ids of a public tokenizer, by words."""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from itertools import compress, count, repeat
from operator import is_

import numpy as np


#: Runs of ASCII marks but the apostrophe, and runs of all else but blanks and line ends.
_UNITS = re.compile(rb"[!-&(-/:-@\[-`{-~]+|[^\n -&(-/:-@\[-`{-~]+")
_MARKS = frozenset(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")


def _apart(unit: str) -> bool:
    """Whether no mark beside a unit can join it: it begins and ends in letters or digits, once normalised."""
    unit = unicodedata.normalize("NFC", unit).lower()
    return unit[0].isalnum() and unit[-1].isalnum()


class WordEncoder:
    """Ids of whole texts as packed little-endian unsigned 32-bit integers.

    The vocabulary's pre-tokenizer never joins characters across a space, nor letters or digits and marks, so
    each run of marks and each run of other characters is encoded once and remembered. Where such a run begins
    or ends in what may join the marks beside it (apostrophes, marks beyond ASCII), its text is cut at spaces
    alone. The memory has two generations of `limit` runs: a full one becomes the older one, and what is still
    used moves over. A text that may name a special token is encoded as a whole.
    """

    def __init__(self, path: str, limit: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._limit = limit
        self._memo: dict[bytes, bytes | bool] = {}
        self._older: dict[bytes, bytes | bool] = {}
        self._words: dict[bytes, bytes] = {}
        vocabulary = self._tokenizer.get_vocab()
        self._closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self._closes[[k for x, k in vocabulary.items() if x.endswith("</w>")]] = True

    def _ids(self, texts: list[str]) -> list[bytes]:
        made = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in made]

    def _letter_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of letters alone, encoded as one text: each ends with its only end-of-word token."""
        packed = np.array(self._tokenizer.encode(b" ".join(words).decode(), add_special_tokens=False).ids, "<u4")
        ends = (4 * (np.flatnonzero(self._closes[packed]) + 1)).tolist()
        if len(ends) != len(words):  # the pre-tokenizer's idea of a letter differs
            return self._ids([x.decode() for x in words])
        packed = packed.tobytes()
        return [packed[a:b] for a, b in zip([0, *ends], ends)]

    def _learn(self, units: set[bytes]) -> None:
        memo, older = self._memo, self._older
        known = units & older.keys()
        memo.update((x, older[x]) for x in known)
        letters, others = [], []
        for unit in units - known if known else units:
            if unit.isalpha():
                letters.append(unit)
            elif unit[0] in _MARKS:
                others.append(unit)
            elif not _apart(text := unit.decode()):
                memo[unit] = False
            else:
                (letters if text.isalpha() else others).append(unit)
        for at in range(0, len(letters), 2000):
            part = letters[at : at + 2000]
            memo.update(zip(part, self._letter_words(part)))
        memo.update(zip(others, self._ids([x.decode() for x in others])))

    def _by_words(self, text: bytes) -> bytes:
        """Ids of a text that is cut at spaces alone; words that aren't in the memory are encoded at once."""
        words = text.split(b" ")
        memo = self._words
        unknown = list(set(words) - memo.keys())
        if unknown:
            if len(memo) + len(unknown) > self._limit // 10:
                memo.clear()
                unknown = list({*words})
            memo.update(zip(unknown, self._ids([x.decode() for x in unknown])))
        return b"".join(map(memo.__getitem__, words))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Packed ids of UTF-8 texts."""
        find, found, unknown = self._memo.get, [], set()
        for text in texts:
            if b"<|" in text:
                found.append(None)
                continue
            # looked up while the runs are fresh; only what is missing is kept of them
            units = _UNITS.findall(text.lower())
            ids = list(map(find, units))
            gaps = list(compress(count(), map(is_, ids, repeat(None)))) if None in ids else ()
            missing = [units[k] for k in gaps]
            unknown.update(missing)
            found.append((ids, gaps, missing))
        if unknown:
            if len(self._memo) + len(unknown) > self._limit:
                self._older, self._memo = self._memo, {}
            self._learn(unknown)
        memo, out = self._memo, []
        for text, own in zip(texts, found):
            if own is None:
                out.append(self._ids([text.decode()])[0])
                continue
            ids, gaps, missing = own
            for k, unit in zip(gaps, missing):
                ids[k] = memo[unit]
            try:
                out.append(b"".join(ids))
            except TypeError:  # a run that may join the marks beside it
                out.append(self._by_words(text.lower().replace(b"\n", b" ")))
        return out


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This process's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def vocabulary_size(path: str) -> int:
    """One more than the greatest id of a vocabulary file."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab().values()) + 1
