"""Byte-pair encoding with word ends, and decoding, against a vocabulary file of the ``tokenizers`` format.

A word is encoded on a contiguous array of ranks: part boundaries and the merge rank of each adjacent pair
lie side by side; the least rank (leftmost on ties) is found by a scan, its boundary is deleted and the two
neighbouring ranks are looked up anew. Words above ``LONG_WORD`` parts take their least rank from a heap,
with the same merges. Results of words are remembered in a task, at most ``REMEMBERED`` at a time, and
forgotten at its end, for the worker goes on to other work.

Text goes through the steps the file asks for: special tokens are cut out, then NFC, white space to one
space, lower case by character, split into words, bytes as symbols. Ids are little-endian unsigned 32-bit
integers in a binary column. Decoding joins the tokens with spaces, as the library does for a file without
a decoder. Letters and lower case are those of the Unicode version at hand: characters that Unicode 15.1 does
not assign may be split otherwise than by the library.

A null text is empty: no tokens, decoded to an empty text. Columns besides the text pass through; ``ids``,
``n_tokens`` and ``decoded`` replace columns of these names. Tasks are independent of each other: nothing is
shuffled.
"""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusflow.llm.tables import slices

LONG_WORD = 200
REMEMBERED = 200_000
_NEVER = 1 << 60
#: Separators that Python counts as white space and the vocabulary file does not.
_SEPARATORS = regex.compile("[\x1c-\x1f]")
_SPACE = regex.compile(r"[^\S\x1c-\x1f]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next one from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class WordBpe:
    """One vocabulary file, read once per Python worker."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        vocabulary = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        splitter = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(splitter["pattern"]["Regex"])
        names = {i: t for t, i in (vocabulary | self.special).items()}
        self.tokens = np.array([names.get(i, "") for i in range(max(names) + 1)], dtype=object)
        symbols = byte_symbols()
        self.inner = [vocabulary[s] for s in symbols]
        self.last = [vocabulary[s + suffix] for s in symbols]
        self.ranks, self.made = {}, []
        for rank, (left, right) in enumerate(tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]):
            self.ranks[vocabulary[left], vocabulary[right]] = rank
            self.made.append(vocabulary[left + right])
        self.known_words: dict[str, bytes] = {}
        self.known_chunks: dict[str, bytes] = {}

    def merge(self, parts: list[int]) -> list[int]:
        """The parts of a word after all merges, by a scan of the rank array."""
        rank_of, made = self.ranks.get, self.made
        ranks = [rank_of(pair, _NEVER) for pair in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == _NEVER:
                break
            at = ranks.index(least)
            parts[at] = made[least]
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank_of((parts[at - 1], parts[at]), _NEVER)
            if at < len(ranks):
                ranks[at] = rank_of((parts[at], parts[at + 1]), _NEVER)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same merges with a heap of (rank, place) over linked parts."""
        rank_of, made, end = self.ranks.get, self.made, len(parts)
        after, before, alive = list(range(1, end + 1)), list(range(-1, end - 1)), [True] * end
        heap = [(r, i) for i in range(end - 1) if (r := rank_of((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, at = heapq.heappop(heap)
            right = after[at]
            if not alive[at] or right == end or rank_of((parts[at], parts[right])) != rank:
                continue
            parts[at], alive[right], after[at] = made[rank], False, after[right]
            if after[at] < end:
                before[after[at]] = at
            for left in (before[at], at):
                if left >= 0 and after[left] < end and (r := rank_of((parts[left], parts[after[left]]))) is not None:
                    heapq.heappush(heap, (r, left))
        return [p for p, a in zip(parts, alive, strict=True) if a]

    def word(self, word: str) -> bytes:
        raw = word.encode()
        parts = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        merged = (self.merge if len(parts) <= LONG_WORD else self.merge_long)(parts)
        return np.array(merged, "<u4").tobytes()

    def chunk(self, chunk: str) -> bytes:
        """Ids of a lower-case piece without white space."""
        known, out = self.known_words, []
        for word in self.words.findall(chunk):
            ids = known.get(word)
            if ids is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                ids = known[word] = self.word(word)
            out.append(ids)
        return b"".join(out)

    def plain(self, text: str, out: list[bytes]) -> None:
        text = unicodedata.normalize("NFC", text)
        text = (text.replace("Σ", "σ") if "Σ" in text else text).lower()
        known = self.known_chunks
        for chunk in _SPACE.split(text) if _SEPARATORS.search(text) else text.split():
            ids = known.get(chunk)
            if ids is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                ids = known[chunk] = self.chunk(chunk)
            out.append(ids)

    def encode(self, text: str) -> bytes:
        out: list[bytes] = []
        for at, piece in enumerate(self.cut.split(text) if self.cut else [text]):
            if at % 2:
                out.append(np.array([self.special[piece]], "<u4").tobytes())
            elif piece:
                self.plain(piece, out)
        return b"".join(out)

    def forget(self) -> None:
        self.known_words.clear()
        self.known_chunks.clear()

    def decode(self, ids: bytes) -> str:
        return " ".join(self.tokens[np.frombuffer(ids, "<u4")].tolist())


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> WordBpe:
    return WordBpe(path)


def _with(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    kept = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n not in columns}
    return pa.RecordBatch.from_pydict(kept | columns)


def _schema(df: DataFrame, **columns: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name not in columns] + [T.StructField(n, t) for n, t in columns.items()])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``ids`` and ``n_tokens`` in place of ``text``."""
    def task(batches):
        bpe = vocabulary(path)
        for batch in slices(batches):
            ids = [bpe.encode(x.as_py() or "") for x in batch.column("text")]
            rest = batch.drop_columns(["text"])
            yield _with(rest, ids=pa.array(ids, pa.binary()), n_tokens=pa.array([len(x) // 4 for x in ids], pa.int64()))
        bpe.forget()

    return docs.mapInArrow(task, _schema(docs.drop("text"), ids=T.BinaryType(), n_tokens=T.LongType()))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded``, the text that its ``ids`` stand for."""
    def task(batches):
        bpe = vocabulary(path)
        for batch in slices(batches):
            texts = [bpe.decode(x.as_py() or b"") for x in batch.column("ids")]
            yield _with(batch, decoded=pa.array(texts, pa.string()))

    return encoded.mapInArrow(task, _schema(encoded, decoded=T.StringType()))
