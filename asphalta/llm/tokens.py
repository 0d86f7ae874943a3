"""Token ids of whole texts by the tokenizers library, asked once for each new word.

The tokenizer drops white space and never joins across it, so a text's ids are the ids
of its white-space separated chunks in order. Arrow splits a batch of texts and tells
the different chunks apart, so that only those reach Python. Chunks of Latin letters
only, or with one mark after them, are reduced to the word in lower case. A task keeps
the ids of words it has seen. New ones of ASCII letters go to the tokenizer's model
alone. Others of letters are encoded many to a call; each is one word to the tokenizer,
so its ids reach to the next that ends a word. All other chunks are encoded one by one.
Texts that hold a special token's string or one of the four control characters that
Arrow, but not the tokenizer, takes for white space go to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words kept by a task, in each of two generations; a full one takes the older's place.
WORDS_KEPT = 100_000
#: Words encoded in one call.
AT_ONCE = 2000
#: Letters with one code point each that are their own composed form and whose lower case is one letter.
PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")
MARKS = ".,;:!?"


class Kept:
    """A bounded memory: when the newer generation is full it takes the older's place."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def get(self, key):
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value):
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        self.new[key] = value
        return value


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = re.compile("|".join([*special, "[\x1c-\x1f]"]))
        # Tried first, as one set of characters is searched for far faster.
        firsts = "".join({re.escape(t.content[0]) for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.suspect = re.compile(f"[{firsts}\x1c-\x1f]")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.marks = pa.array([*self._library(list(MARKS)), b""], pa.large_binary())
        # Whether the model alone gives the ids of ASCII words, tried on those of the vocabulary.
        tried = [t[:-4] for t in vocabulary if re.fullmatch("[a-z]+</w>", t)][:AT_ONCE]
        self.direct = self._model(tried) == self._library(tried)
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _model(self, words: list[str]) -> list[bytes]:
        """Ids by the model alone, which is spared normalising and cutting."""
        cut = self.tokenizer.model.tokenize
        return [array("I", [token.id for token in cut(word)]).tobytes() for word in words]

    def _plain_words(self, words: list[str]) -> list[bytes]:
        """Ids of words of Latin letters in lower case."""
        out = []
        for at in range(0, len(words), AT_ONCE):
            part = words[at:at + AT_ONCE]
            [found] = self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            cuts = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            if len(cuts) != len(part):
                raise ValueError("the tokenizer cuts words of letters")
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *cuts], cuts)]
        return out

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of new words, which are added to those kept."""
        if len(self.words) > WORDS_KEPT:
            self.older, self.words = self.words, {}
        learnt, simple, plain, others = {}, [], [], []
        for word in new:
            if (known := self.older.get(word)) is not None:
                learnt[word] = known
            elif not PLAIN.fullmatch(word):
                others.append(word)
            else:
                (simple if self.direct and word.isascii() else plain).append(word)
        learnt.update(zip(simple, self._model(simple)))
        learnt.update(zip(plain, self._plain_words(plain)))
        learnt.update(zip(others, self._library(others)))
        self.words.update(learnt)
        return learnt

    def _chunks(self, chunks: pa.Array) -> pa.Array:
        """Ids of different chunks: those of the word in lower case and of the mark, or of the chunk as it is."""
        plain = pc.match_substring_regex(chunks, f"^{PLAIN.pattern}[{MARKS}]?$")
        words = pc.if_else(plain, pc.utf8_lower(pc.utf8_rtrim(chunks, MARKS)), chunks).dictionary_encode()
        names = words.dictionary.to_numpy(zero_copy_only=False).tolist()  # far faster than to_pylist
        ids = list(map(self.words.get, names))
        if None in ids:
            learnt = self._learn([w for w, i in zip(names, ids) if i is None])
            ids = [learnt[w] if i is None else i for w, i in zip(names, ids)]
        mark = pc.index_in(pc.utf8_slice_codeunits(chunks, -1), pa.array(list(MARKS)))
        mark = pc.fill_null(pc.if_else(plain, mark, None), len(MARKS))
        return pc.binary_join_element_wise(
            pa.array(ids, pa.large_binary()).take(words.indices), self.marks.take(mark), pa.scalar(b"", pa.large_binary()))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        texts = [t or "" for t in texts]
        suspect, whole = self.suspect.search, self.whole.search
        apart = [i for i, t in enumerate(texts) if suspect(t) and whole(t)]
        rest = list(texts)
        for i in apart:
            rest[i] = ""
        split = pc.utf8_split_whitespace(pa.array(rest, pa.string()))
        chunks = split.flatten().dictionary_encode()
        ids = self._chunks(chunks.dictionary).take(chunks.indices)
        # The ids of all chunks lie one after another; a text's reach from its first chunk to the next text's.
        _, ends, raw = ids.buffers()
        cuts = np.frombuffer(ends, np.int64)[split.offsets.to_numpy()].tolist() if len(ids) else [0] * (len(texts) + 1)
        data = memoryview(raw or b"")
        out = [bytes(data[a:b]) for a, b in zip(cuts, cuts[1:])]
        for i in apart:
            [out[i]] = self._library([texts[i]])
        return out


@lru_cache(2)
def encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker."""
    return WordEncoder(path)
