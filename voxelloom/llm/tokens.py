"""Token ids of whole texts by a public tokenizer file."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from itertools import compress, repeat
from operator import is_

import numpy as np

#: Chunks, and the words in them, that one Python worker remembers.
REMEMBERED = 300_000
#: Words that are encoded as one text.
JOINED = 64
#: Characters on which Python and the tokenizer disagree as to white space.
_ODD = "\x1c\x1d\x1e\x1f"
_LETTERS = re.compile(r"[^\W\d_]+")
#: Scripts for which lower case is left to the tokenizer, and the one letter below them that becomes two.
_BEYOND_LATIN = re.compile("[İɐ-\U0010ffff]")


class ChunkEncoder:
    """Encodes texts chunk by chunk, where a chunk stands between white space.

    The tokenizer file splits texts at white space, and words from what is not a letter, before it merges; it marks the token
    that ends a word. So the ids of a text are those of its chunks one after the other, a chunk that begins with a
    word has the word's ids first, and words that were encoded together can be told apart. Chunks and words that come
    again are looked up. Texts that may hold a special token, or a character that only one side takes for white space,
    are encoded whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = sorted({t.content for t in self.tokenizer.get_added_tokens_decoder().values()})
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[number for token, number in vocabulary.items() if token.endswith("</w>")]] = True
        self.chunks: dict[str, bytes] = {}  # words and what follows them are chunks, too

    def _encode(self, texts: Sequence[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def _encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of lower-case words of letters only."""
        names, found = list(words), {}
        parts = [names[at : at + JOINED] for at in range(0, len(names), JOINED)]
        for part, joined in zip(parts, self._encode([" ".join(part) for part in parts]), strict=True):
            stops = (4 * (np.flatnonzero(self.ends[np.frombuffer(joined, dtype="<u4")]) + 1)).tolist()
            if len(stops) == len(part) and stops[-1] == len(joined):
                found |= {word: joined[a:b] for word, a, b in zip(part, [0, *stops[:-1]], stops, strict=True)}
            else:
                found |= dict(zip(part, self._encode(part), strict=True))
        return found

    def _encode_chunks(self, chunks: Iterable[str]) -> dict[str, bytes]:
        known, split, words, others = self.chunks, [], set(), set()
        new: dict[str, bytes] = {}
        letters, beyond = _LETTERS.match, _BEYOND_LATIN.search
        for chunk in chunks:
            low = chunk.lower()
            if low.isalpha() and not beyond(chunk):
                if low in known:
                    new[chunk] = known[low]
                else:
                    words.add(low)
                    if low != chunk:
                        split.append((chunk, low, ""))
                continue
            match = None if beyond(chunk) else letters(low)
            if match:
                word = match.group()
                rest = low[len(word) :]
                if word.isalpha() and rest[0].isascii():
                    split.append((chunk, word, rest))
                    if word not in known:
                        words.add(word)
                    if rest not in known:
                        others.add(rest)
                    continue
            others.add(chunk)
        fresh = self._encode_words(words)
        names = list(others)
        if names:
            fresh |= zip(names, self._encode(names), strict=True)
        of = lambda x: known[x] if x in known else fresh[x]
        for chunk, word, rest in split:
            new[chunk] = of(word) + of(rest) if rest else of(word)
        # words and what follows them come again in other chunks
        return new | fresh

    def _whole(self, text: str) -> bool:
        return any(c in text for c in _ODD) or any(s in text for s in self.special)

    def __call__(self, texts: Sequence[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        get = self.chunks.get
        chunks = [None if self._whole(text) else text.split() for text in texts]
        found = [None if own is None else list(map(get, own)) for own in chunks]
        missing = set()
        for own, ids in zip(chunks, found, strict=True):
            if ids and None in ids:
                missing.update(compress(own, map(is_, ids, repeat(None))))
        new = self._encode_chunks(missing) if missing else {}
        out = []
        for text, own, ids in zip(texts, chunks, found, strict=True):
            if ids is None:
                out += self._encode([text])
            else:
                out.append(b"".join([new[c] if i is None else i for c, i in zip(own, ids, strict=True)] if None in ids else ids))
        if len(self.chunks) < REMEMBERED:
            self.chunks |= new
        return out


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder per file and Python worker."""
    import os

    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def word_bpe() -> str:
    """Place of the word-level tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
