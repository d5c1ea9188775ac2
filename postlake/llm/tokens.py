"""Token ids of whole texts by the tokenizers library, through their white-space-free chunks.

The pre-tokenizer of ``word_bpe_49k.json`` drops white space and never joins across it, and its normaliser
works within white-space-free runs. So a text's ids are those of its chunks between blanks and line feeds,
one after another, and each distinct chunk of a portion is encoded once. A chunk of letters with punctuation behind
it is the two in a row, as the pre-tokenizer parts letters from marks. Words of letters alone are one word each to
the pre-tokenizer and their last id is one that ends a word, so many of them pass through the library as one text,
whose ids are parted behind such ids; where the number of parts is another than that of words, and for all other
chunks, each passes through the library alone.
"""

from __future__ import annotations

import os
from array import array
from functools import lru_cache
from string import ascii_letters, punctuation

import numpy as np
import pyarrow as pa

from .common import ChunkCoder

#: Chunks whose ids are kept, about 120 MB: the library's model is dear.
KEPT = 1 << 19
#: Words that pass through the library as one text.
TOGETHER = 256


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        suffix = self.tokenizer.model.end_of_word_suffix
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        if suffix:
            self.ends[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        self.model = self.tokenizer.model
        #: Whether the model alone gives what the library gives for each ASCII letter's words.
        letters = [*ascii_letters, ascii_letters, *ascii_letters.upper()]
        self.plain = [array("I", [t.id for t in self.model.tokenize(w.lower())]).tobytes() for w in letters] == self._each(letters)
        self.coder = ChunkCoder(self._learn, "<u4", kept=KEPT)

    def _each(self, chunks: list[str]) -> list[bytes]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # before each use: another operator in this worker may want threads
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters. ASCII words need no more than lower case before the model."""
        plain = {w: array("I", [t.id for t in self.model.tokenize(w.lower())]).tobytes() for w in words if w.isascii()} if self.plain else {}
        if plain:
            found = dict(zip(rest, self._joined(rest), strict=True)) if (rest := [w for w in words if w not in plain]) else {}
            return [plain[w] if w in plain else found[w] for w in words]
        return self._joined(words)

    def _joined(self, words: list[str]) -> list[bytes]:
        lists = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        out = []
        for some, ids in zip(lists, self._each([" ".join(x) for x in lists]), strict=True):
            at = np.flatnonzero(self.ends[np.frombuffer(ids, "<u4")]) + 1
            if len(at) == len(some) and 4 * at[-1] == len(ids):
                at = [0, *(4 * at).tolist()]
                out += [ids[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
            else:
                out += self._each(some)
        return out

    def _learn(self, chunks: list[str]) -> list[bytes]:
        stems = [c if c.isalpha() else c.rstrip(punctuation) for c in chunks]
        have, known = self.coder.known, {}
        for w in dict.fromkeys(stems):
            if w.isalpha():
                known[w] = have.get(w)
        words = [w for w, ids in known.items() if ids is None]
        known.update(zip(words, self._words(words), strict=True))
        tails = [c[len(w) :] if w in known else c for c, w in zip(chunks, stems, strict=True)]
        rest = [t for t in dict.fromkeys(tails) if t and t not in have]
        other = dict(zip(rest, self._each(rest), strict=True)) | {"": b""}
        return [known[w] + (other.get(t) if t in other else have[t]) if w in known else other[t] if t in other else have[t] for t, w in zip(tails, stems, strict=True)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's ids begin and end."""
        return self.coder.encode(texts)

    def encode_one(self, text: str | None) -> np.ndarray:
        return self.encode(pa.array([text], pa.string()))[0]

    def with_end(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The same with an end id behind each text."""
        ids, at = self.encode(texts)
        return np.insert(ids, at[1:], np.uint32(end)).astype("<u4"), at + np.arange(len(at))


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)
