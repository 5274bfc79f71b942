"""Token counts by heap-and-linked-list byte-pair merging.

Each chunk of the pre-tokenizer starts as one symbol per byte. The adjacent
pair of lowest rank is popped from a heap and merged in a doubly linked list
until no pair has a rank; the count is the initial symbols minus the merges.
No identifiers are produced, and each worker keeps counts of chunks it has seen.

Null text counts as empty (0 tokens); repeated rows and repeated ids keep one
result row each; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import heapq
import json

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_texts, tokenizer_path

#: Chunks remembered by one worker; beyond it the memory starts afresh.
CACHE_ENTRIES = 600_000
#: The split pattern of the vocabulary, as its public file states it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of these characters are split by the pattern here; others by the library's own splitter.
PLAIN = regex.compile(r"[\t\n\r\x20-\x7E\xA1-ɏ‐-‧‰-⁞€]*")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself where printable, else 256 and up in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ChunkCounter(dict):
    """chunk -> number of tokens, computed when first asked for."""

    def __init__(self, path: str):
        super().__init__()
        spec = json.load(open(path, encoding="utf-8"))
        ids = spec["model"]["vocab"]
        self.byte = [0] * 256
        for char, b in byte_alphabet().items():
            self.byte[b] = ids[char]
        #: pair of adjacent symbols (one integer) -> rank of its merge; and what each rank makes.
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for i, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank[ids[a] << 20 | ids[b]] = i
            self.made.append(ids[a + b])
        self.special = [t["content"] for t in spec["added_tokens"]]

    def __missing__(self, chunk: str) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        n = self[chunk] = self.merged_length(chunk.encode())
        return n

    def merged_length(self, data: bytes) -> int:
        rank, made = self.rank.get, self.made
        symbol = list(map(self.byte.__getitem__, data))
        n = left = len(symbol)
        heap = [r << 32 | i for i, r in enumerate(map(rank, [a << 20 | b for a, b in zip(symbol, symbol[1:])])) if r is not None]
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        symbol.append(-1)  # stands at the end and is in no pair
        while heap:
            item = heapq.heappop(heap)
            r, i = item >> 32, item & 0xFFFFFFFF
            j = after[i]
            if symbol[i] < 0 or j >= n or rank(symbol[i] << 20 | symbol[j]) != r:
                continue  # one side has been merged meanwhile
            new = symbol[i] = made[r]
            symbol[j] = -1
            left -= 1
            after[i] = k = after[j]
            before[k] = i
            if k < n and (q := rank(new << 20 | symbol[k])) is not None:
                heapq.heappush(heap, q << 32 | i)
            h = before[i]
            if h >= 0 and (q := rank(symbol[h] << 20 | new)) is not None:
                heapq.heappush(heap, q << 32 | h)
        return left


@functools.lru_cache(maxsize=2)
def counter(file: str):
    """A function text -> tokens for a vocabulary file; one per worker."""
    path = tokenizer_path(file)
    chunks = ChunkCounter(path)
    split = regex.compile(PATTERN).findall
    special = regex.compile("|".join(map(regex.escape, chunks.special)))

    def others(text: str) -> list[str]:
        """The library's splitter, for characters whose classes may differ between Unicode versions."""
        from tokenizers import Tokenizer

        if not hasattr(chunks, "splitter"):
            chunks.splitter = Tokenizer.from_file(path).pre_tokenizer
        return [text[a:b] for a, b in (at for _, at in chunks.splitter.pre_tokenize_str(text))]

    def count(text: str) -> int:
        total = 0
        if chunks.special and "<" in text:
            total = len(special.findall(text))
        for part in special.split(text) if total else [text]:
            pieces = split(part) if PLAIN.fullmatch(part) else others(part)
            total += sum(map(chunks.__getitem__, pieces))
        return total

    return count


def count_tokens(
    docs: DataFrame, file: str = "byte_bpe_50k.json", limit: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row; ``file`` names a byte-level BPE vocabulary."""

    def rows(texts: list[str]) -> dict[str, list]:
        count = counter(file)
        return {"n_bytes": [len(t.encode()) for t in texts], "n_tokens": [count(t) for t in texts]}

    out = map_texts(id_and_text(docs, id_col, text_col), rows, "n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
