"""BPE encoding by backtracking over longest matches, decoding by an offset table.

A word is written over an alphabet of one character for each byte and one for each byte
that ends a word. An Aho-Corasick automaton over all tokens gives the longest token that
starts at each place. The encoder takes the longest match and goes on while the pair
with the token before is compatible, that is if merging the two texts in order of merge
ranks would keep the border between them; otherwise it takes the next shorter token,
and goes back one token when there is none. Places from which nothing can follow are
remembered, so each is left at most once and the work is linear in the word. Every word
then has the tokens that merging pair by pair by rank gives it.

A task keeps the ids of words and chunks that it has seen. Texts are split into words by the
tokenizer's own pattern, or by its library outside the Latin letters; strings of special tokens are cut out first.

Decoding looks up each id's bytes in one buffer by an offset table and joins tokens as
the tokenizer without a decoder does, with a space.

Defined cases: null is the empty text, with no ids; repeated rows and null ids are rows
like any other; an empty table gives an empty result; other columns pass through, those
named ids or decoded give way.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import query, small_batches, table
from .tokens import MARKS, PLAIN, Kept, default_tokenizer

SPACE = r"\t\n\x0b\x0c\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Up to here letters are single code points with a lower case of the same kind.
LATIN_END = "\u0250"
BLANKS = regex.compile(f"[{SPACE}]+")
WORD_END = "</w>"
#: Chunks, and words, kept by a task in each of two generations.
CHUNKS_KEPT = 200_000


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, and its byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Backtracking:
    """Encoder and decoder of a byte-level BPE tokenizer file with word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library, self.of_char = Tokenizer.from_file(path), byte_characters()
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        vocabulary, merges = config["model"]["vocab"], config["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in config["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        step = next(n for n in config["pre_tokenizer"]["pretokenizers"] if n["type"] == "Split")
        self.pattern = regex.compile(step["pattern"]["Regex"].replace(r"\s", SPACE))
        self._token_tables(vocabulary, merges)
        self._decoder_tables(vocabulary)
        self.chunks, self.words = Kept(CHUNKS_KEPT), Kept(CHUNKS_KEPT)
        self.mark_ids = {m: self.ids_of_word(m.encode()) for m in MARKS} | {"": ()}

    def _token_tables(self, vocabulary: dict[str, int], merges: list) -> None:
        import ahocorasick

        of_char = self.of_char

        def letters(token: str) -> str:
            """The token over the alphabet of bytes and word-ending bytes."""
            ends = token.endswith(WORD_END)
            codes = [of_char[c] for c in (token.removesuffix(WORD_END) if ends else token)]
            return "".join(map(chr, codes[:-1])) + chr(codes[-1] + 256 * ends)

        # Ids in order of merge rank, the single letters first; ranks are what compatibility compares.
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in merges]
        single = [t for t in vocabulary if len(t.removesuffix(WORD_END)) == 1]
        ranked = [*single, *(a + b for a, b in pairs)]
        rank = {t: i for i, t in enumerate(ranked)}
        self.id_of = [vocabulary[t] for t in ranked]
        self.text_of = [letters(t) for t in ranked]
        self.length_of = list(map(len, self.text_of))
        self.merged = {(rank[a], rank[b]): rank[a + b] for a, b in pairs}
        self.halves = [(i, i) for i in range(len(single))] + [(rank[a], rank[b]) for a, b in pairs]
        self.by_text = {t: i for i, t in enumerate(self.text_of)}
        self.joins: dict[tuple[int, int], bool] = {}
        # A token that merging never builds from its own letters is never a match.
        alive = [i < len(single) or self._built(i) for i in range(len(ranked))]
        self.automaton = ahocorasick.Automaton()
        for i, text in enumerate(self.text_of):
            if alive[i]:
                self.automaton.add_word(text, i)
        self.automaton.make_automaton()
        # The next shorter token that is a prefix of a token, -1 if none.
        self.shorter = [-1] * len(ranked)
        for i, text in enumerate(self.text_of):
            for end in range(len(text) - 1, 0, -1):
                if (j := self.by_text.get(text[:end])) is not None and alive[j]:
                    self.shorter[i] = j
                    break

    def _built(self, token: int) -> bool:
        """Merging the token's letters by rank gives the token."""
        parts = [self.by_text[c] for c in self.text_of[token]]
        while len(parts) > 1:
            rank, at = min(((r, i) for i, p in enumerate(zip(parts, parts[1:])) if (r := self.merged.get(p)) is not None),
                           default=(None, 0))
            if rank is None:
                return False
            parts[at:at + 2] = [rank]
        return parts[0] == token

    def compatible(self, left: int, right: int) -> bool:
        """Merging the two tokens' texts together keeps the border between them."""
        known = self.joins.get((left, right))
        if known is None:
            known = self.joins[left, right] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        # Undo merges from the last one: at no point may an earlier merge cross the border.
        limit = len(self.text_of)
        while True:
            if self.merged.get((left, right), limit) < limit:
                return False
            undo_left = left > right
            for _ in range(2):
                if undo_left and self.halves[left][1] != left:
                    limit, left = left, self.halves[left][1]
                    break
                if not undo_left and self.halves[right][0] != right:
                    # A merge on the right loses a tie against one across the border.
                    limit, right = right + 1, self.halves[right][0]
                    break
                undo_left = not undo_left
            else:
                return True

    def word(self, letters: str) -> list[int]:
        """Token ranks of a word over the alphabet of bytes and word-ending bytes."""
        longest, length_of, joins = self._longest(letters), self.length_of, self.joins
        out: list[int] = []
        at, dead = 0, bytearray(len(letters) + 1)
        token = longest[0] if letters else -1
        while at < len(letters):
            end = at + length_of[token]
            if not dead[end]:
                joined = not out or joins.get((out[-1], token))
                if joined or joined is None and self.compatible(out[-1], token):
                    out.append(token)
                    at = end
                    token = longest[at] if at < len(letters) else -1
                    continue
            while (token := self.shorter[token]) < 0:
                dead[at] = 1
                token = out.pop()
                at -= self.length_of[token]
        return out

    def _longest(self, letters: str) -> list[int]:
        """The longest token that starts at each place."""
        best, length_of = [-1] * len(letters), self.length_of
        # Matches come by their ends, so the last one from a place is the longest.
        for end, token in self.automaton.iter(letters):
            best[end + 1 - length_of[token]] = token
        return best

    def _decoder_tables(self, vocabulary: dict[str, int]) -> None:
        names = {i: t.encode() for t, i in (vocabulary | self.special).items()}
        parts = [names.get(i, b"") for i in range(max(names) + 1)]
        self.buffer = b" ".join(parts) + b" "
        self.offsets = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts]))).tolist()

    def split(self, chunk: str) -> list[bytes]:
        """The words of a piece of text without special tokens, as the tokenizer cuts it."""
        if max(chunk) < LATIN_END:
            return [w.encode() for w in self.pattern.findall(chunk.lower())]
        # Other scripts: the library knows which edition of Unicode it goes by.
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))
        return [bytes(map(self.of_char.__getitem__, word)) for word, _ in cut]

    def ids_of_word(self, codes: bytes) -> tuple[int, ...]:
        letters = codes[:-1].decode("latin-1") + chr(codes[-1] + 256)
        return tuple(map(self.id_of.__getitem__, self.word(letters)))

    def ids_of_chunk(self, chunk: str) -> tuple[int, ...]:
        """Ids of a run of characters between blanks.

        Latin letters with at most one mark after them are one word, whose ids are kept
        whatever its case and mark.
        """
        if not chunk:
            return ()
        body, mark = (chunk[:-1], chunk[-1]) if chunk[-1] in self.mark_ids else (chunk, "")
        if body.isalpha() and (body.isascii() or PLAIN.fullmatch(body)):
            word = body.lower()
            ids = self.words.get(word)
            if ids is None:
                ids = self.words.put(word, self.ids_of_word(word.encode()))
            return ids + self.mark_ids[mark]
        return tuple(i for word in self.split(chunk) for i in self.ids_of_word(word))

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        for part in self.cut.split(text or "") if self.cut else [text or ""]:
            if part in self.special:
                ids.append(self.special[part])
                continue
            kept = self.chunks
            chunks = self._chunks(part)
            for chunk, found in zip(chunks, map(kept.new.get, chunks)):
                if found is None and (found := kept.get(chunk)) is None:
                    found = kept.put(chunk, self.ids_of_chunk(chunk))
                ids += found
        return ids

    def _chunks(self, part: str) -> list[str]:
        """Runs of characters between blanks; no word goes over one."""
        if part.isascii() and not any(c in part for c in "\x1c\x1d\x1e\x1f"):
            return part.split()
        return BLANKS.split(part)

    def decode(self, ids: Iterable[int]) -> str:
        buffer, offsets = self.buffer, self.offsets
        return b"".join([buffer[offsets[i]:offsets[i + 1]] for i in ids])[:-1].decode()


@lru_cache(2)
def coder(path: str) -> Backtracking:
    """The coder of this Python worker."""
    return Backtracking(path)


def encode(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """docs with ids, an array of the token ids of the text."""
    path = tokenizer or default_tokenizer()
    return _with(docs, text_col, "ids", T.ArrayType(T.IntegerType()), pa.list_(pa.int32()),
                 lambda texts: map(coder(path).encode, texts))


def decode(encoded: DataFrame, ids_col: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """encoded with decoded, the text of the ids."""
    path = tokenizer or default_tokenizer()
    return _with(encoded, ids_col, "decoded", T.StringType(), pa.string(),
                 lambda rows: map(coder(path).decode, rows), id_lists)


def id_lists(column: pa.ListArray) -> list[list[int]]:
    """The lists of a column, empty where null, cut from one list of all values."""
    values = column.flatten().to_numpy(zero_copy_only=False).tolist()
    ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
    return [values[start:end] for start, end in zip([0, *ends], ends)]


def _with(df: DataFrame, source: str, name: str, kind: T.DataType, arrow: pa.DataType, make, read=pa.Array.to_pylist) -> DataFrame:
    through = df.drop(name) if name != source else df
    place = through.columns.index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            made = pa.array(list(make(read(batch.column(place)))), arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, name])

    return through.mapInArrow(run, T.StructType([*through.schema.fields, T.StructField(name, kind)]))


@query("op3_bpe")
def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    coded = decode(encode(table(spark, folder, "documents").select("doc_id", "text")).drop("text"))
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
