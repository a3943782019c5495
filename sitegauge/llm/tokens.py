"""Token ids of whole texts with the tokenizers library, one call per distinct word.

The word-level vocabulary splits at white space and drops it, so the ids of a text are the ids of its words in
order. Words repeat, so each task encodes a word once and gathers ids with numpy. Words may also be cut between an
ASCII letter and the marks in ``_MARKS``: the pre-tokenizer always cuts there. All other rules (Unicode
normalisation, contractions, digits, special tokens) are left to the library.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 1
CHUNK_BYTES = 4 << 20   # workers live on, and so does the most memory that a chunk has needed
CACHED_WORDS = 500_000
_MARKS = r"([A-Za-z])([,.!%#$&*]+)"


def public_vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public vocabulary file on this machine."""
    import public_tokenizers
    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of texts, with the ids of words seen before kept in flat arrays (at most ``CACHED_WORDS`` words)."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self._forget()

    def _forget(self) -> None:
        self.words = pa.array([], pa.string())
        self.ids = np.zeros(0, np.uint32)
        self.first = np.zeros(1, np.int64)

    def _learn(self, new: pa.Array) -> None:
        """Append the ids of words that are not yet kept."""
        model, rest = self.tokenizer.model.tokenize, self.tokenizer
        plain = pc.match_substring_regex(new, "^[a-z]+$").to_numpy(zero_copy_only=False)
        words = new.to_pylist()
        encoded = iter(rest.encode_batch_fast([w for w, p in zip(words, plain) if not p], add_special_tokens=False))
        lists = [[t.id for t in model(w)] if p else next(encoded).ids for w, p in zip(words, plain)]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((i for ids in lists for i in ids), np.uint32, int(counts.sum()))
        self.words = pa.concat_arrays([self.words, new])
        self.ids = np.concatenate([self.ids, flat])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(counts)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the number of ids of every text. NULL counts as empty."""
        texts = pc.replace_substring_regex(pc.fill_null(texts, ""), pattern=_MARKS, replacement=r"\1 \2")
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        raw = coded.dictionary
        # Lower-casing first keeps ids the same for plain ASCII; a special token's name must keep its case.
        fold = pc.and_(pc.string_is_ascii(raw), pc.invert(pc.match_substring(raw, "<|")))
        lower = pc.if_else(fold, pc.ascii_lower(raw), raw).dictionary_encode()
        words = lower.dictionary
        if len(self.words) + len(words) > CACHED_WORDS:
            self._forget()
        known = pc.index_in(words, value_set=self.words)
        new = pc.is_null(known)
        at = pc.fill_null(known, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        fresh = new.to_numpy(zero_copy_only=False)
        at[fresh] = len(self.words) + np.arange(fresh.sum())
        self._learn(words.filter(new))
        at = at[lower.indices.to_numpy(zero_copy_only=False)][coded.indices.to_numpy(zero_copy_only=False)] \
            if len(words) else np.zeros(0, np.int64)
        counts = (self.first[1:] - self.first[:-1])[at]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.first[at] - (ends - counts), counts) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[split.offsets.to_numpy(zero_copy_only=False)]
        return ids, np.diff(bounds)

    def documents(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Chunks of (index of the first text, ids with the end id after each text, ends of the texts)."""
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        first = 0
        while first < len(texts):
            held = np.cumsum(sizes[first:])
            last = first + max(1, int(np.searchsorted(held, CHUNK_BYTES, side="right")))
            ids, counts = self.encode(texts.slice(first, last - first))
            ends = np.cumsum(counts + 1)
            full = np.empty(int(ends[-1]), np.uint32)
            marks = np.zeros(len(full), bool)
            marks[ends - 1] = True
            full[marks] = END_ID
            full[~marks] = ids
            yield first, full, ends
            first = last


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(vocabulary: str) -> WordEncoder:
    """One encoder per Python worker, so that words stay known between tasks."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = WordEncoder(vocabulary)
    return _ENCODERS[vocabulary]
