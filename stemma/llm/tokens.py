"""Whole-text encoding with a public tokenizer file through the tokenizers library.

The byte-level pre-tokenizer never joins characters across a single space that stands between two
non-space characters, so a text may be cut there and each piece encoded once and remembered. The
library encodes every distinct piece; texts that hold an added token's string go to it whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

from .common import worker_cache

END_ID = 0
#: Pieces an encoder remembers (about 200 bytes each) before it starts afresh.
CACHE_PIECES = 1_200_000
_TWO_SPACES = re.compile(r"\s\s")
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class PieceEncoder:
    """encode(texts) -> list of uint32 arrays, equal to encode_batch(texts, add_special_tokens=False).

    A piece is what stands between two cuts; all but a text's first keep the space before them. A
    piece of letters with closing marks is two tokens of the pre-tokenizer, so its ids are those of
    the letters and those of the marks.
    """

    MARKS = ".,!?;:"

    def __init__(self, path: str, max_pieces: int = CACHE_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.max_pieces = max_pieces
        vocabulary = self.tokenizer.get_vocab()
        #: Whether an id's token begins with a space (written as the byte-level alphabet has it).
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        self._reset()

    def _reset(self) -> None:
        self.first: dict[str, int] = {}  # pieces without a space before them
        self.later: dict[str, int] = {}  # by what follows their space
        self.flat = np.empty(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 14, np.int64)  # ends[i + 1] closes piece i
        self.count = 0

    def _append(self, names: list[str], index: dict[str, int], lens: np.ndarray, ids: np.ndarray) -> None:
        base, n = int(self.ends[self.count]), len(names)
        while base + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.count + n + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[base : base + len(ids)] = ids
        self.ends[self.count + 1 : self.count + 1 + n] = base + np.cumsum(lens)
        index.update(zip(names, range(self.count, self.count + n)))
        self.count += n

    def _gather(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = self.ends[pieces]
        lens = self.ends[pieces + 1] - starts
        shift = np.repeat(starts - (np.cumsum(lens) - lens), lens)
        return lens, self.flat[shift + np.arange(len(shift))]

    def _learn_words(self, words: list[str]) -> list[str]:
        """Learn pieces of letters alone, many in one text; returns those whose places can't be told.

        Every such piece with its space is a token group of its own whose first token alone begins
        with the space, so the groups' starts part a text's ids.
        """
        runs = [words[a : a + 256] for a in range(0, len(words), 256)]
        left: list[str] = []
        for at in range(0, len(runs), 64):
            part = runs[at : at + 64]
            for run, e in zip(part, self.tokenizer.encode_batch_fast([" " + " ".join(run) for run in part], add_special_tokens=False)):
                ids = np.array(e.ids, np.uint32)
                starts = np.flatnonzero(self.opens[ids])
                if len(starts) == len(run) and starts[0] == 0:
                    self._append(run, self.later, np.diff(np.append(starts, len(ids))), ids)
                else:
                    left += run
        return left

    def _learn(self, names: list[str], index: dict[str, int], space: str) -> None:
        for at in range(0, len(names), 20_000):
            part = names[at : at + 20_000]
            encoded = [e.ids for e in self.tokenizer.encode_batch_fast([space + p for p in part], add_special_tokens=False)]
            lens = np.fromiter(map(len, encoded), np.int64, len(encoded))
            self._append(part, index, lens, np.fromiter(chain.from_iterable(encoded), np.uint32, int(lens.sum())))

    def _learn_later(self, names: set[str]) -> None:
        marked = [(p, stem) for p in names if p[-1:] in self.MARKS and (stem := p.rstrip(self.MARKS)).isalpha()]
        names.difference_update(p for p, _ in marked)
        names.update(stem for _, stem in marked if stem not in self.later)
        words = [p for p in names if p.isalpha()]
        names.difference_update(words)
        self._learn([*names, *self._learn_words(words)], self.later, " ")
        if marked:
            tails = [p[len(stem) :] for p, stem in marked]
            self._learn(list(set(tails).difference(self.first)), self.first, "")
            halves = np.array([(self.later[stem], self.first[t]) for (_, stem), t in zip(marked, tails)], np.int64)
            lens, ids = self._gather(halves.ravel())
            self._append([p for p, _ in marked], self.later, lens.reshape(-1, 2).sum(1), ids)

    @staticmethod
    def _cut(text: str) -> list[str]:
        if _TWO_SPACES.search(text) or text[:1].isspace() or text[-1:].isspace():
            return _SAFE_CUT.split(text)
        return text.split(" ")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.count > self.max_pieces:
            self._reset()
        whole = [any(s in t for s in self.special) for t in texts]
        cuts = [[] if w or not t else self._cut(t) for t, w in zip(texts, whole)]
        heads = [cut.pop(0) if cut else None for cut in cuts]
        self._learn(list({h for h in heads if h is not None}.difference(self.first)), self.first, "")
        numbers = [np.fromiter(map(self.later.get, cut, repeat(-1)), np.int64, len(cut)) for cut in cuts]
        unknown = [np.flatnonzero(n < 0).tolist() for n in numbers]
        self._learn_later({cut[i] for cut, at in zip(cuts, unknown) for i in at})
        for cut, n, at in zip(cuts, numbers, unknown):
            if at:
                n[at] = [self.later[cut[i]] for i in at]
        out = []
        for text, head, n, w in zip(texts, heads, numbers, whole):
            if w:
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32))
            elif head is None:
                out.append(np.zeros(0, np.uint32))
            else:
                out.append(self._gather(np.concatenate([[self.first[head]], n]))[1])
        return out


def encoder(path: str, max_pieces: int = CACHE_PIECES) -> PieceEncoder:
    """One encoder for each tokenizer file and worker process."""
    cache = worker_cache("tokens")
    if path not in cache:
        cache[path] = PieceEncoder(path)
    cache[path].max_pieces = max_pieces
    return cache[path]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, max_chars: int = 1_000_000) -> Iterator[tuple[list, list[str]]]:
    """(keys, texts) of at most ``rows`` rows and about ``max_chars`` characters (a longer text stands alone); null texts are empty."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            keys, texts = part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]
            start = size = 0
            for i, t in enumerate(texts):
                if size and size + len(t) > max_chars:
                    yield keys[start:i], texts[start:i]
                    start, size = i, 0
                size += len(t)
            yield keys[start:], texts[start:]
