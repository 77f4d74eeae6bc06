"""Whole texts to token ids, with a cache of words in front of the tokenizer.

The vocabularies used here split at white space before anything else, and none of
their steps looks across an ASCII space, tab or line end. A text's ids are hence
the ids of its words in order. Words repeat far more than texts, so each worker
keeps the ids of words it has met and asks the tokenizer for new words only, once
for a group of small texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

from .worker import held

WORD_BPE = "word_bpe_49k.json"
#: Words a worker keeps; beyond it the cache starts anew, so memory is bounded.
CACHED_WORDS = 1_200_000
#: Bytes of a text split at a time; a long text never becomes one list of words.
PIECE_BYTES = 1 << 20
_SPACE = b" \t\n\r\x0b\x0c"
_BYTES = np.arange(256)
_LETTER = (_BYTES >= ord("a")) & (_BYTES <= ord("z"))
_STOP = (_BYTES == ord(".")) | (_BYTES == ord(","))
_GAP = np.isin(_BYTES, list(_SPACE))
#: Slots of the table in front of the words' dictionary, as a power of two.
_SLOT_BITS = 20
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(WORD_BPE)


def pieces(text: bytes, size: int = PIECE_BYTES) -> Iterator[bytes]:
    """``text`` in parts of about ``size`` bytes, cut before white space only."""
    at, end = 0, len(text)
    while end - at > size:
        cuts = [c for c in (text.rfind(bytes([s]), at + 1, at + size) for s in _SPACE) if c > 0]
        if cuts:
            cut = max(cuts)
        else:
            cuts = [c for c in (text.find(bytes([s]), at + size) for s in _SPACE) if c > 0]
            cut = min(cuts, default=end)
        yield text[at:cut]
        at = cut
    if at < end:
        yield text[at:]


def folded(text: bytes) -> bytes:
    """``text`` as it is cut: ASCII case never matters to these vocabularies."""
    return text if b"<|" in text else text.lower()  # the names of special tokens keep their case


def spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the units that are tokenized alike wherever they stand.

    A full stop or comma between an ASCII letter and white space is always a token of
    its own; told apart, far fewer units differ.
    """
    word = ~_GAP[raw]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    stop = _STOP[raw[1:]] & last[1:] & _LETTER[raw[:-1]]
    first[1:] |= stop
    last[:-1] |= stop
    return np.flatnonzero(first), np.flatnonzero(last) + 1


class _Codes(dict):
    """Words to numbers; a word that is not there gets the next one and is noted in ``new``."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        self[word] = code = len(self)
        return code


class WordTokenizer:
    """Encodes texts by words; one per worker process, see :func:`shared`.

    All words have a number in a dictionary. Words of up to 16 bytes are first looked for
    in a table of slots, all words of a group of texts at once: a slot holds the bytes
    of the word that last came to it, so what is found there is exact.
    """

    def __init__(self, path: str, cached_words: int = CACHED_WORDS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._cached = cached_words
        self._clear()

    def _clear(self) -> None:
        self._codes = _Codes()
        self._ids = np.empty(1 << 20, np.uint32)
        self._bounds = np.zeros(1 << 18, np.int64)
        self._slots = np.zeros((1 << _SLOT_BITS, 2), np.uint64)
        self._slot_codes = np.zeros(1 << _SLOT_BITS, np.int64)

    def _learn(self, words: list[bytes]) -> None:
        """One call for all new words: a token belongs to the word it starts in."""
        texts = [w.decode() for w in words]
        found = self._tokenizer.encode(" ".join(texts), add_special_tokens=False)
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])
        starts = np.array([a for a, _ in found.offsets], np.int64)
        n = np.diff(np.searchsorted(starts, begins))
        code, more = len(self._codes) - len(words), len(starts)
        at = int(self._bounds[code])
        while at + more > len(self._ids):
            self._ids = np.concatenate([self._ids, np.empty_like(self._ids)])
        while code + len(words) + 1 > len(self._bounds):
            self._bounds = np.concatenate([self._bounds, np.zeros_like(self._bounds)])
        self._ids[at : at + more] = found.ids
        self._bounds[code + 1 : code + 1 + len(words)] = at + np.cumsum(n)

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        """The words' numbers by the dictionary; new words are learnt."""
        codes = self._codes
        try:
            got = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
            if codes.new:
                self._learn(codes.new)
                codes.new = []
        except BaseException:
            self._clear()  # words without ids must not stay
            raise
        return got

    def _lookup(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(begins, numbers) of the words of a folded text."""
        if len(self._codes) > self._cached:
            self._clear()
        begins, ends = spans(np.frombuffer(text, np.uint8))
        padded, size = text + bytes(16), ends - begins
        eights = np.ndarray(len(text) + 9, "<u8", padded, strides=(1,))  # the 8 bytes from each place
        one = eights[begins] & _HEAD[np.minimum(size, 8)]
        two = eights[begins + 8] & _HEAD[np.clip(size - 8, 0, 8)]
        slot = (((one ^ (two * _ODD[0])) * _ODD[1]) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        fits = size <= 16
        if b"\0" in text:  # a word's zero bytes look like what follows a shorter word
            fits[:] = False
        held = self._slots[slot]
        got = self._slot_codes[slot]
        missing = np.flatnonzero(~(fits & (held[:, 0] == one) & (held[:, 1] == two)))
        if len(missing):
            at = zip(begins[missing].tolist(), ends[missing].tolist(), strict=True)
            got[missing] = self._numbers([text[a:b] for a, b in at])
            short = missing[fits[missing]]
            short = short[np.unique(slot[short], return_index=True)[1]]  # one word a slot
            self._slots[slot[short]] = np.stack([one[short], two[short]], axis=1)
            self._slot_codes[slot[short]] = got[short]
        return begins, got

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each of some folded texts."""
        ends = np.cumsum([len(t) + 1 for t in texts])
        begins, got = self._lookup(b"\n".join(texts))
        start, n = self._bounds[got], self._bounds[got + 1] - self._bounds[got]
        done = np.concatenate([[0], np.cumsum(n)])
        ids = self._ids[np.arange(int(done[-1])) + np.repeat(start - done[:-1], n)]
        return np.split(ids, done[np.searchsorted(begins, ends[:-1])])

    def encode(self, text: str | None) -> Iterator[np.ndarray]:
        """The ids of a whole text, in order, in arrays of bounded length."""
        for part in pieces((text or "").encode()):
            (ids,) = self._encode([folded(part)])
            if len(ids):
                yield ids

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[Iterable[np.ndarray]]:
        """What :meth:`encode` gives, of each text; small texts are looked up together."""
        held: list[bytes] = []
        size = 0
        for text in texts:
            raw = (text or "").encode()
            if held and size + len(raw) > PIECE_BYTES:
                yield from ([ids] for ids in self._encode(held))
                held, size = [], 0
            if len(raw) > PIECE_BYTES:
                yield self.encode(text)
            else:
                held.append(folded(raw))
                size += len(raw)
        if held:
            yield from ([ids] for ids in self._encode(held))


def shared(path: str) -> WordTokenizer:
    """The worker's tokenizer of this file, with its cache."""
    return held(("words", path), lambda: WordTokenizer(path))
