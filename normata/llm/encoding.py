"""Token ids of whole texts by a public tokenizer, an Arrow array at a time.

The vocabulary's pieces never span ASCII white space, so a text's ids are those of its words; it folds
case, so ASCII capitals are folded first; and signs after a letter or digit are pieces of their own, so
``word.`` has the ids of ``word`` and of ``.``. Splitting, telling words apart and laying out ids are array
operations; Python meets each distinct word of a part once, and the tokenizer each word that the worker
has not met before.

Defined results: null and empty texts have no ids; a text of any length is encoded whole, with memory
of a few times its own size; a special token counts as one in lower case only, as for the tokenizer.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from normata.llm.common import give_back

#: Bytes of text that become words at a time (one text at least).
PART = 4 << 20
ALNUM = np.array([chr(i).isascii() and chr(i).isalnum() for i in range(256)])


def parts(texts: pa.Array, size: int = PART) -> Iterator[pa.Array]:
    """The texts in slices of about ``size`` bytes."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    which = (np.cumsum(sizes) - sizes) // size
    edges = [0, *(np.flatnonzero(np.diff(which)) + 1).tolist(), len(texts)]
    for a, b in zip(edges, edges[1:], strict=False):
        yield texts.slice(a, b - a)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, codes, bounds): the distinct words of the texts, between ASCII white space, each text's words as places
    among them, and where the texts begin and end in these. The empty text may be among the distinct words, but no code is its."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words = lists.flatten().dictionary_encode()
    codes = words.indices.to_numpy().astype(np.int64)
    full = pc.not_equal(words.dictionary, "").to_numpy(zero_copy_only=False)[codes]
    ends = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))
    return words.dictionary, codes[full], np.append(0, np.cumsum(full))[ends]


def cut_signs(words: pa.Array, signs: str) -> tuple[pa.Array, pa.Array]:
    """(stems, rest): words without the signs that follow a last ASCII letter or digit, and these signs; other words stay whole."""
    words = words.cast(pa.large_string())  # the copy begins its buffers anew
    stems = pc.ascii_rtrim(words, characters=signs)
    size, kept = (pc.binary_length(x).to_numpy() for x in (words, stems))
    ends = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset)[1:]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    cut = (kept < size) & (kept > 0)
    cut[cut] = ALNUM[data[(ends - size + kept - 1)[cut]]]
    n = np.where(cut, size - kept, 0)
    to = np.append(0, np.cumsum(n))
    raw = data[np.repeat(ends - n - to[:-1], n) + np.arange(to[-1])]
    rest = pa.Array.from_buffers(pa.large_string(), len(words), [None, pa.py_buffer(to.astype(np.int64)), pa.py_buffer(raw)])
    return pc.if_else(pa.array(cut), stems, words).cast(pa.string()), rest.cast(pa.string())


def laid_out(start: np.ndarray, length: np.ndarray, pool: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``pool`` that begin at ``start``, one after the other, and where each begins and ends."""
    ends = np.append(0, np.cumsum(length, dtype=np.int64))
    return pool[np.repeat(start - ends[:-1], length) + np.arange(ends[-1])], ends


class WordEncoder:
    """Ids of texts, from a cache of the ids of words; a full cache starts anew.

    The cache is a few arrays, some 40 bytes a word: the words in the order in which they were met, where ``pool``
    has their ids, and the pool. Its first word is the empty one, of no ids. Words are kept without the signs after them.
    """

    LIMIT, LONGEST, TOGETHER = 600_000, 64, 400
    SIGNS = ".,!?;:*$%&#"

    def __init__(self, path: str, limit: int = LIMIT):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks use the cores
        self.encoder, self.limit = Tokenizer.from_file(path), limit
        # the same model without what leaves words of a to z as they are: normal forms, case, signs
        self.plain = Tokenizer(self.encoder.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.encoder.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([""], pa.string())
        self.start, self.length = np.zeros(1, np.int64), np.zeros(1, np.int32)
        self.pool = np.zeros(0, np.uint32)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.encoder.encode(text, add_special_tokens=False).ids, np.uint32)

    def keep(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        """New words and their ids, one after the other."""
        self.known = pa.concat_arrays([self.known, pa.array(words, pa.string())])
        self.start = np.append(self.start, len(self.pool) + np.cumsum(lengths) - lengths)
        self.length = np.append(self.length, lengths.astype(np.int32))
        self.pool = np.append(self.pool, ids)

    def slots_of(self, words: pa.Array) -> np.ndarray:
        """The words' places among those known; -1 for others."""
        return pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy().astype(np.int64)

    def ids_of(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a row of known words, and where each word's end."""
        return laid_out(self.start[slots], self.length[slots], self.pool)

    def joined(self, words: list[str]) -> Iterator[str]:
        for at in range(0, len(words), self.TOGETHER):
            yield " ".join(words[at : at + self.TOGETHER])

    def letters(self, encoder, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of words of letters only, many at a time, and their numbers: a word's last id says so. None if some word is of several pieces."""
        found = encoder.encode_batch_fast(list(self.joined(words)), add_special_tokens=False)
        ids = np.concatenate([np.array(f.ids, np.uint32) for f in found])
        ends = np.flatnonzero(self.last[ids]) + 1
        return (ids, np.diff(ends, prepend=0)) if len(ends) == len(words) and ends[-1] == len(ids) else None

    def mixed(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of any words, many at a time, told apart by where their ids begin, and their numbers."""
        ids, lengths = [], []
        for at, text in zip(range(0, len(words), self.TOGETHER), self.joined(words), strict=True):
            found = self.encoder.encode(text, add_special_tokens=False)
            begins = np.cumsum([0, *(len(w) + 1 for w in words[at : at + self.TOGETHER])])
            ids.append(np.array(found.ids, np.uint32))
            lengths.append(np.diff(np.searchsorted([o[0] for o in found.offsets], begins)))
        return np.concatenate(ids), np.concatenate(lengths)

    def learn(self, words: pa.Array) -> None:
        """Ids of words not met before."""
        test = lambda f: f(words).to_numpy(zero_copy_only=False)
        short = pc.utf8_length(words).to_numpy() <= self.LONGEST
        plain = short & test(pc.ascii_is_alpha) & test(pc.ascii_is_lower)
        letters = short & test(pc.utf8_is_alpha) & ~plain
        of = lambda which: words.filter(pa.array(which)).to_pylist()
        for encoder, some in ((self.plain, of(plain)), (self.encoder, of(letters))):
            if some:
                self.keep(some, *(self.letters(encoder, some) or self.mixed(some)))
        if some := of(short & ~plain & ~letters):
            self.keep(some, *self.mixed(some))
        for word in of(~short):
            ids = self.encode(word)
            self.keep([word], ids, np.array([len(ids)]))

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, and where each word's end."""
        both = pa.chunked_array(cut_signs(words, self.SIGNS)).combine_chunks().dictionary_encode()
        own = both.dictionary
        if len(self.known) + len(own) > self.limit:
            self.clear()
        slots = self.slots_of(own)
        unmet = slots < 0
        if unmet.any():
            # what is learned is in the order of kinds, so its places are looked up among the new words alone
            before = len(self.known)
            new = own.filter(pa.array(unmet))
            self.learn(new)
            slots[unmet] = before + pc.index_in(new, value_set=self.known.slice(before)).to_numpy()
        ids, ends = self.ids_of(slots[both.indices.to_numpy().reshape(2, -1).T.ravel()])
        return ids, ends[::2]

    def part(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        low = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        lists = pc.ascii_split_whitespace(low)
        words = lists.flatten().dictionary_encode()
        pool, at = self.words(words.dictionary)
        codes = words.indices.to_numpy()
        ids, ends = laid_out(at[codes], np.diff(at)[codes], pool)
        return ids, ends[np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))]

    def arrays(self, texts: pa.Array, size: int = PART) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, bounds) of successive slices of the texts of ``size`` bytes: text i of a slice has ids[bounds[i]:bounds[i + 1]]."""
        for slice_ in parts(texts, size):
            yield self.part(slice_)
        give_back()

    def texts(self, texts: list[str | None] | pa.Array) -> Iterator[bytes]:
        """Each text's ids, as little-endian 32-bit bytes."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        for ids, bounds in self.arrays(texts):
            raw, at = ids.astype("<u4").tobytes(), (4 * bounds).tolist()
            for a, b in zip(at, at[1:], strict=False):
                yield raw[a:b]

    def text(self, text: str | None) -> bytes:
        return next(self.texts([text]))


@lru_cache(maxsize=1)
def encoder_for(path: str, limit: int = WordEncoder.LIMIT) -> WordEncoder:
    """The worker's encoder: its words, ``limit`` of them, stay known from one task to the next."""
    return WordEncoder(path, limit)
