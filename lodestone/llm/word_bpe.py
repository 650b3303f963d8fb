"""Ids of the word-end BPE vocabulary, by the tokenizers library, encoded once for each distinct word.

Normalisation, splitting and merging of this vocabulary never look across a blank, nor across the split pattern's
matches, so the ids of a text are those of its parts one after another. Parts repeat, so most cost one look-up."""

from __future__ import annotations

import os
import re

import numpy as np

_BOUND = 400_000
#: The vocabulary's split pattern over lower-case Latin-1: its letters, its digits, and all else but blanks.
_LATIN = re.compile("[a-zªµºß-öø-ÿ]+|'(?:[stmd]|re|ve|ll)|[0-9²³¹¼½¾]|[^\t-\r \x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼½¾]+")
_loaded: dict[str, WordBPE] = {}


class WordBPE:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.wide = np.dtype("<u2") if max(vocabulary.values()) < 1 << 16 else np.dtype("<u4")
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        """Each word is one match of the split pattern, so its ids end at the first that ends a word."""
        for i in range(0, len(words), 4000):
            part = words[i : i + 4000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype=self.wide)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part):  # not this vocabulary's kind of word end
                for w in part:
                    self.words[w] = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, dtype=self.wide).tobytes()
                continue
            data, wide, start = ids.tobytes(), self.wide.itemsize, 0
            for w, end in zip(part, (cuts * wide).tolist()):
                self.words[w] = data[start:end]
                start = end

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.words) > _BOUND:
            self.words = {}
        known = self.words
        split: list[list[str] | None] = []
        for text in texts:
            try:
                text.encode("latin-1")
                split.append(_LATIN.findall(text.lower()))
            except UnicodeEncodeError:
                split.append(None)
        self._learn(list({w for s in split if s is not None for w in s if w not in known}))
        out = []
        for text, s in zip(texts, split):
            if s is None:
                out.append(np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.wide))
            else:
                out.append(np.frombuffer(b"".join([known[w] for w in s]), dtype=self.wide))
        return out


def load(path: str) -> WordBPE:
    """One vocabulary for each worker process."""
    if path not in _loaded:
        _loaded[path] = WordBPE(path)
    return _loaded[path]
