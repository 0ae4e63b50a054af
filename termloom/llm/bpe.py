"""BPE encoding and decoding with contiguous rank arrays.

A vocabulary file (``tokenizers`` JSON: lower case, white space dropped, word ends marked) is applied by own code:
text is normalised, split into words, and each word's bytes are merged. A short word is held as its parts and, beside
them, one contiguous array of the merge ranks of adjacent parts. The array is scanned for its minimum, the boundary there
is deleted and the neighbouring ranks are looked up anew, until no adjacent parts merge. Long words, where scans would be
quadratic, keep their boundaries in a linked list and the ranks in a heap. Words repeat, so each worker remembers a
bounded number of them. Python's character tables and the library's are of different Unicode versions: texts with
characters that only one of them knows are normalised and split by the library, and merged here like all others.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words of more parts use the heap.
SHORT = 96
#: Words of a generation that a worker remembers (two generations at a time, some 200 MB), and the longest of them.
REMEMBERED, REMEMBERED_CHARS = 300_000, 64
_NEVER = 1 << 40
_NONE = (_NEVER, -1)

#: Characters that the vocabulary's normaliser takes for white space (fixed values: Unicode White_Space).
_WHITE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Codec:
    """Encodes texts to ids and decodes ids, as the vocabulary file says."""

    def __init__(self, path: str):
        self.path, self.library, self.foreign = path, None, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        char = {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in keep)}
        self.byte = {c: b for b, c in char.items()}
        self.inner = [vocab[char[b]] for b in range(256)]
        self.last = [vocab[char[b] + self.end] for b in range(256)]
        self.merges: dict[int, tuple[int, int]] = {}  # pair of ids -> (rank, id)
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.merges.setdefault(vocab[a] << 20 | vocab[b], (rank, vocab[a + b]))
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.white = regex.compile(f"[{_WHITE}]+")
        self.known: dict[str, tuple[int, bytes, str]] = {}
        self.before: dict[str, tuple[int, bytes, str]] = {}  # the generation before; words that recur move on

    def normalise(self, text: str) -> str:
        if not text.isascii():
            text = self.white.sub(" ", unicodedata.normalize("NFC", text)).replace("Σ", "σ")
        return text.lower()

    def own_tables_do(self, text: str) -> bool:
        """Whether Python's character tables treat a text as the library's do."""
        if text.isascii():
            return True
        if self.foreign is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.foreign = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.combining(c) and not self._agree(c))
        return not any(c in self.foreign or unicodedata.category(c) == "Cn" for c in set(text))

    def _agree(self, mark: str) -> bool:
        """Whether the library puts a combining mark among others of several classes as Python does."""
        text = "".join(f"e{mark}{other}e{other}{mark}" for other in "\u0327\u0323\u0301\u0345")
        return self.library.normalizer.normalize_str(text) == self.normalise(text)

    def split(self, text: str) -> list[str]:
        """The normalised words of a text without special tokens."""
        if self.own_tables_do(text):
            return self.words.findall(self.normalise(text))
        spans = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.byte.__getitem__, word)).decode() for word, _ in spans]

    def merge_short(self, parts: list[int]) -> list[int]:
        """Contiguous ranks of adjacent parts, scanned for the leftmost minimum."""
        merges = self.merges.get
        none = _NONE
        ranks = [merges(a << 20 | b, none)[0] for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == _NEVER:
                break
            at = ranks.index(least)
            new = parts[at] = merges(parts[at] << 20 | parts[at + 1])[1]
            del parts[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = merges(new << 20 | parts[at + 1], none)[0]
            if at:
                ranks[at - 1] = merges(parts[at - 1] << 20 | new, none)[0]
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same merges through a heap of (rank, place) and linked places."""
        merges, n = self.merges, len(parts)
        after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n)
        heap = []

        def push(i: int) -> None:
            if after[i] < n and (f := merges.get(parts[i] << 20 | parts[after[i]])):
                heapq.heappush(heap, (f[0], i, parts[i], parts[after[i]]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i] = merges[a << 20 | b][1]
            gone[j] = 1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [p for p, dead in zip(parts, gone, strict=True) if not dead]

    def word(self, word: str) -> tuple[int, bytes, str]:
        """Number of ids, ids as little-endian unsigned 32-bit integers, decoded text of one word."""
        found = self.before.get(word)
        if found is None:
            raw = word.encode()
            parts = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
            ids = self.merge_short(parts) if len(parts) <= SHORT else self.merge_long(parts)
            found = len(ids), struct.pack(f"<{len(ids)}I", *ids), " ".join([self.tokens[i] for i in ids])
        if len(word) <= REMEMBERED_CHARS:
            if len(self.known) >= REMEMBERED:
                self.before = dict(self.known)
                self.known.clear()
            self.known[word] = found
        return found

    def _encoded(self, text: str) -> list[tuple[int, bytes, str]]:
        out, known = [], self.known
        for part in self.marks.split(text) if self.marks and "<|" in text else [text]:
            if part in self.special:
                out.append((1, self.special[part].to_bytes(4, "little"), part))
            elif part:
                out += [known.get(w) or self.word(w) for w in self.split(part)]
        return out

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        return np.frombuffer(b"".join([w[1] for w in self._encoded(text)]), dtype="<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: the vocabulary has no decoder, so tokens stand side by side, parted by blanks."""
        return " ".join([self.tokens[i] for i in np.asarray(ids).tolist() if i in self.tokens])

    def round_trip(self, text: str) -> tuple[bytes, str]:
        """Ids as bytes, and the text they decode to; words are decoded once and remembered."""
        found = self._encoded(text)
        return b"".join([w[1] for w in found]), " ".join([w[2] for w in found])


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One for each worker process and file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids (array of int), decoded text of each row; a null text counts as empty and has no ids.

    Repeated rows are encoded each, an empty table gives no rows, other columns are ignored.
    """
    common.prepare(docs.sparkSession)

    def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary or default_vocabulary())
        for batch in common.in_slices(batches):
            found = [own.round_trip(t) for t in common.texts_of(batch)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "ids": pa.array([np.frombuffer(raw, dtype="<u4").astype(np.int32) for raw, _ in found], pa.list_(pa.int32())),
                "decoded": pa.array([text for _, text in found], pa.string()),
            })

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_encode, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row; the ids stay in the task that makes them.

    A null text counts as empty. Repeated rows give repeated rows, an empty table none; other columns are ignored.
    """
    common.prepare(docs.sparkSession)

    def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary or default_vocabulary())
        for batch in common.in_slices(batches):
            found = [own.round_trip(t) for t in common.texts_of(batch)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array([len(raw) // 4 for raw, _ in found], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(raw).hexdigest() for raw, _ in found], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(text.encode()).hexdigest() for _, text in found], pa.string()),
            })

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
