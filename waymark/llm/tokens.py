"""Token ids by the tokenizers library: the distinct words of a block of texts are encoded once each.

A block's texts are split and their words numbered by Arrow, so that Python sees distinct words
only; the ids of all words are then gathered at once. Ids of letter-only words are kept per worker.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from itertools import product

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task has one core

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from waymark.llm._common import WHITE_CHARS, chunks

#: Text bytes that are encoded at once.
BLOCK_BYTES = 4 << 20
#: Words whose ids a worker keeps; a table that is full starts anew.
ENTRIES = 600_000
#: Words that the library gets in one string.
JOINED = 64
#: ASCII marks behind a word, and a word of Latin-1 letters (with the newline before it, where that is kept); the patterns of both tokenizers break between them.
MARKS = ".,;:!?#*$%&|"
MARK_PLACE = np.array([max(0, MARKS.find(chr(c))) for c in range(256)])
LETTERS = "^\\n?[A-Za-zÀ-ÖØ-öø-ÿ]+$"
#: Texts with any of these are split by `chunks`: two white spaces in a row, and white space that Arrow does not split at.
DOUBLE = ["".join(x) for x in product(" \n", repeat=2)]
ODD = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
WIDE = "".join(c for c in WHITE_CHARS if not c.isascii())


def uneven(text: str) -> bool:
    return any(x in text for x in DOUBLE) or any(x in text for x in ODD) or not text.isascii() and any(x in text for x in WIDE)


def spaced(word: str) -> str:
    """A word with what parts it from the one before: a newline, which it has already, or a space."""
    return word if word[:1] == "\n" else " " + word


class Table:
    """Ids of numbered entries, end to end in one array that grows."""

    def __init__(self) -> None:
        self.ids, self.ends, self.n = np.empty(1024, "<u4"), np.zeros(1024, np.int64), 0

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        end = int(self.ends[self.n])
        while len(self.ids) < end + len(ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while len(self.ends) < self.n + len(lengths) + 1:
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[end : end + len(ids)] = ids
        self.ends[self.n + 1 : self.n + len(lengths) + 1] = end + np.cumsum(lengths)
        self.n += len(lengths)


def gather(ids: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The runs of ids that begin at `start`, one after another."""
    shift = start - (np.cumsum(length) - length)
    return ids[np.repeat(shift, length) + np.arange(int(length.sum()))]


class ChunkEncoder:
    """Ids of whole texts by a byte-level tokenizer without normaliser, or by one that folds case and drops white space.

    The patterns of both break wherever white space begins, so a text's ids are those of its
    chunks in order. Control strings in a text are ordinary text, as the tables' description has it.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.spaced = json.loads(self.library.to_str())["pre_tokenizer"]["type"] == "ByteLevel"
        tokens = [self.library.id_to_token(i) or "" for i in range(self.library.get_vocab_size())]
        # where a word begins in ids of words joined together: at a token with a space, or behind one with a word's end
        self.edge = np.array([t.startswith("Ġ") or t == "Ċ" if self.spaced else t.endswith("</w>") for t in tokens])
        self.forget()

    def forget(self) -> None:
        self.table = Table()
        self.known: dict[str, int] = {}  # letter-only words (behind a space or a newline, where these matter)
        self.others: dict[str, int] = {}  # whole chunks

    def _singly(self, chunks_: list[str]) -> None:
        """Add chunks to the table."""
        for i in range(0, len(chunks_), 2048):
            found = [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(chunks_[i : i + 2048], add_special_tokens=False)]
            self.table.add(np.concatenate(found), np.array([len(x) for x in found], np.int64))

    def _joined(self, words: list[str]) -> None:
        """Add words, each one match of the pattern, to the table."""
        for i in range(0, len(words), 32 * JOINED):
            groups = [words[j : j + JOINED] for j in range(i, min(len(words), i + 32 * JOINED), JOINED)]
            found = self.library.encode_batch_fast([" ".join(g) if not self.spaced else "".join(map(spaced, g)) for g in groups], add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, "<u4") for e in found])
            edges = np.flatnonzero(self.edge[ids])
            cuts = np.append(edges, len(ids)) if self.spaced else np.append(0, edges + 1)
            if len(cuts) - 1 != sum(map(len, groups)):
                raise ValueError("words joined together are not told apart")
            self.table.add(ids, np.diff(cuts))

    def _entries(self, wanted: list[str], known: dict[str, int], add: Callable[[list[str]], None]) -> np.ndarray:
        """Places in the table of what is wanted, which is added where it is new."""
        found = list(map(known.get, wanted))
        if None in found:
            new = list(dict.fromkeys(w for w, i in zip(wanted, found) if i is None))
            first = self.table.n
            add(new)
            known.update(zip(new, range(first, self.table.n)))
            found = map(known.__getitem__, wanted)
        return np.fromiter(found, np.int64, len(wanted))

    def _words(self, distinct: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, length) of words without white space around them; behind a space, where spaces matter."""
        core = pc.utf8_rtrim(distinct, characters=MARKS)
        plain = pc.match_substring_regex(core, LETTERS).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(plain)
        letters = core.take(pa.array(at)) if self.spaced else pc.utf8_lower(core.take(pa.array(at)))
        coded = letters.dictionary_encode()
        letter = self._entries(coded.dictionary.to_pylist(), self.known, self._joined)[coded.indices.to_numpy()]
        # a word is its letters and what else it has: two places in the table, side by side
        # (one mark behind letters is the usual rest, and looked up by its byte)
        more = pc.binary_length(distinct).to_numpy() - pc.binary_length(core).to_numpy()
        one = np.flatnonzero(plain & (more == 1))
        marks = self._entries(list(MARKS), self.others, self._singly)
        last = np.frombuffer(distinct.buffers()[2] or b"", np.uint8)[np.frombuffer(distinct.buffers()[1], np.int32)[one + distinct.offset + 1] - 1]
        other = np.flatnonzero(~plain | (more > 1))
        whole = distinct.take(pa.array(other)).to_pylist()
        skip = np.where(plain[other], pc.utf8_length(core.take(pa.array(other))).to_numpy(), -1)
        rest = self._entries([w[k:] if k >= 0 else spaced(w) if self.spaced else w for w, k in zip(whole, skip.tolist())], self.others, self._singly)
        start, length = (np.zeros((len(distinct), 2), np.int64) for _ in range(2))
        for column, rows, entry in ((0, at, letter), (1, one, marks[MARK_PLACE[last]]), (1, other, rest)):
            start[rows, column] = self.table.ends[entry]
            length[rows, column] = self.table.ends[entry + 1] - self.table.ends[entry]
        both = length.sum(1)
        return gather(self.table.ids, start.ravel(), length.ravel()), np.cumsum(both) - both, both

    def _even(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that are not uneven."""
        column = pa.array(texts, pa.string())
        lists = pc.split_pattern(pc.replace_substring(column, "\n", " \n"), " ") if self.spaced else pc.ascii_split_whitespace(column)
        coded = lists.values.dictionary_encode()
        ids, start, length = self._words(coded.dictionary)
        code, offsets = coded.indices.to_numpy().astype(np.int64), lists.offsets.to_numpy()
        if self.spaced:  # a text's first word has no space before it
            bare = self._entries([t.split(" ", 1)[0].split("\n", 1)[0] for t in texts], self.others, self._singly)
            sizes = self.table.ends[bare + 1] - self.table.ends[bare]
            code[offsets[:-1]] = len(start) + np.arange(len(texts))
            start = np.concatenate([start, len(ids) + np.cumsum(sizes) - sizes])
            length, ids = np.concatenate([length, sizes]), np.concatenate([ids, gather(self.table.ids, self.table.ends[bare], sizes)])
        own = length[code]
        ends = np.concatenate([[0], np.cumsum(own)])[offsets]
        return np.split(gather(ids, start[code], own), ends[1:-1])

    def _uneven(self, text: str) -> np.ndarray:
        entry = self._entries(chunks(text, keep=self.spaced), self.others, self._singly)
        return gather(self.table.ids, self.table.ends[entry], self.table.ends[entry + 1] - self.table.ends[entry])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.known) + len(self.others) > ENTRIES:
            self.forget()
        odd = [uneven(t) for t in texts]
        even = [t for t, x in zip(texts, odd) if not x]
        found = iter(self._even(even) if even else [])
        return [self._uneven(t) if x else next(found) for t, x in zip(texts, odd)]


_made: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder of this file."""
    if path not in _made:
        _made[path] = ChunkEncoder(path)
    return _made[path]
