"""Token ids in seekable zstandard files.

A file is a row of independent zstandard frames, each with some whole documents,
then one skippable frame with a directory (first document of each frame), then
the seek table of the public seekable format: compressed and decompressed size
and a checksum (low half of XXH64) of every frame. A reader opens the seek table
at the end, then decompresses only the frames that hold requested documents.

Inside a frame: the number of documents, then for each its id, whether it has
one, and its number of tokens, then all token ids (little-endian, 32 bits).

Documents are written in ascending id order, one file per range partition, under
a name of its own for each attempt; only files named in the stored manifest
count, so a lost executor or a repeated task leaves no wrong data. Null ids come
first; null text is empty (only the end id); equal ids and equal rows all stay,
in order of their text's hash; an empty table gives no files and no rows.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import id_and_text, new_folder, stored, tokenizer_path

#: Magic numbers of the public zstandard seekable format.
SKIPPABLE_SEEK, SKIPPABLE_DIRECTORY, SEEK_MAGIC = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
#: Tokens after which a frame is closed.
FRAME_TOKENS = 65_536
HEADER = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("n", "<u8")])


#: Words whose ids one worker remembers (some 50 bytes each); beyond it the half of least use is forgotten.
WORDS_KNOWN = 300_000
#: Characters of texts encoded together: each time the words known are hashed anew.
TEXTS_AT_ONCE = 4_000_000
#: Texts of these characters alone are encoded word by word: no piece of the library's
#: splitter crosses their white space, and none of them composes with another.
PLAIN = re.compile(r"[\t\n\r\x20-\x7E\xA1-\u012F\u0131-\u024F\u2010-\u2027\u2030-\u205E\u20AC]*")


#: A run of ASCII symbols between a letter and white space is a piece of its own (Arrow's regular expressions).
STOP = r"(\pL)([!-/:-@\[-`{-~]+)([\t\n\r ]|$)", r"\1 \2\3"


class WordEncoder:
    """Token ids by the tokenizers library, which sees each distinct word once; other texts it gets whole.

    Texts are split, words looked up and ids put together as Arrow arrays, a slice of the rows at a time.
    """

    def __init__(self, file: str, most: int = WORDS_KNOWN):
        self.most = most
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer.from_file(tokenizer_path(file))
        self.model.no_truncation()
        self.model.no_padding()
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        #: The same model for lower-case words of letters, which need no normalizer and no splitter but white space.
        self.letters = Tokenizer(self.model.model)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        every = " ".join(c * n for c in map(chr, range(0x2100)) if c.isalpha() and PLAIN.fullmatch(c) for n in (1, 3))
        if not np.array_equal(self.raw(every), self.raw(pc.utf8_lower(pa.scalar(every)).as_py(), self.letters)):
            raise ValueError("words of letters are not split by white space alone in this vocabulary")
        #: Words known, the ids of each as bytes, the call that used it last, and whether it was met again.
        self.words, self.ids = pa.array([], pa.string()), pa.array([], pa.large_binary())
        self.used, self.again, self.calls = np.zeros(0, np.int64), np.zeros(0, bool), 0
        #: Which ids end a piece of the splitter.
        self.ends = np.zeros(self.model.get_vocab_size(), bool)
        self.ends[[i for t, i in self.model.get_vocab().items() if t.endswith("</w>")]] = True

    def raw(self, text: str, model: Any = None) -> np.ndarray:
        # the form without offsets: same ids
        return np.array((model or self.model).encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def learn(self, words: list[str]) -> None:
        """Words of letters are one piece each and go to the library together; others one by one."""
        letters, others = [w for w in words if w.isalpha()], [w for w in words if not w.isalpha()]
        ids, sizes = [], []
        for at in range(0, len(letters), 500):
            some = letters[at : at + 500]
            ids.append(self.raw(" ".join(some), self.letters))
            cuts = np.flatnonzero(self.ends[ids[-1]]) + 1
            if len(cuts) != len(some):
                raise ValueError("a word of letters is not one piece of this vocabulary")
            sizes.append(np.diff(cuts, prepend=0))
        for at in range(0, len(others), 500):
            some = [x.ids for x in self.model.encode_batch_fast(others[at : at + 500], add_special_tokens=False)]
            ids.append(np.fromiter(chain.from_iterable(some), "<u4"))
            sizes.append(np.fromiter(map(len, some), np.int64))
        edges = np.cumsum(np.concatenate([[0], *sizes]), dtype=np.int64) * 4
        new = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(edges), pa.py_buffer(np.concatenate(ids))])
        self.words, self.ids = pa.concat_arrays([self.words, pa.array(letters + others, pa.string())]), pa.concat_arrays([self.ids, new])
        self.used = np.concatenate([self.used, np.full(len(words), self.calls)])
        self.again = np.concatenate([self.again, np.zeros(len(words), bool)])

    def forget(self) -> None:
        """Keep the half of most use: words met in several calls first, then those used last."""
        order = np.lexsort((-self.used, ~self.again))
        keep = np.sort(order[: self.most // 2])
        self.words, self.ids = self.words.take(pa.array(keep)), self.ids.take(pa.array(keep))
        self.used, self.again = self.used[keep], self.again[keep]

    def ids_of(self, words: pa.StringArray) -> pa.LargeBinaryArray:
        """The ids of each word; those not known are learned first."""
        self.calls += 1
        if len(self.words) > self.most:
            self.forget()
        known = len(self.words)
        place = pc.index_in(words, value_set=self.words)
        missing = words.filter(place.is_null())
        place = place.fill_null(-1).to_numpy().copy()
        met = np.bincount(place + 1, minlength=known + 1)[1:] > 0
        self.used[met], self.again[met] = self.calls, True
        if len(missing):
            self.learn(missing.unique().to_pylist())
            place[place < 0] = known + pc.index_in(missing, value_set=self.words.slice(known)).to_numpy()
        return self.ids.take(pa.array(place))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        plain = [PLAIN.fullmatch(t) is not None and not any(x in t for x in self.special) for t in texts]
        lower = pc.utf8_lower(pa.array([t for t, p in zip(texts, plain) if p], pa.string()))
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(lower, *STOP))
        ids = self.ids_of(split.flatten())
        edges = np.frombuffer(ids.buffers()[1], np.int64)[split.offsets.to_numpy()].tolist() if len(ids) else [0] * (len(split) + 1)
        data = memoryview(ids.buffers()[2] or b"")
        parts = (bytes(data[a:b]) for a, b in zip(edges, edges[1:]))
        return [next(parts) if p else self.raw(t).tobytes() for t, p in zip(texts, plain)]


@functools.lru_cache(maxsize=2)
def encoder(file: str, most: int = WORDS_KNOWN) -> WordEncoder:
    return WordEncoder(file, most)


def encoded(texts: list[str], file: str, end_id: int) -> Iterator[np.ndarray]:
    """Token ids of each text and the end id, some texts at a time."""
    encode, tail = encoder(file, WORDS_KNOWN).encode, struct.pack("<I", end_id)
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= TEXTS_AT_ONCE):
            size += len(texts[to])
            to += 1
        for ids in encode(texts[at:to]):
            yield np.frombuffer(ids + tail, "<u4")
        at = to


class FrameWriter:
    """Writes one file to an open binary stream."""

    def __init__(self, stream: Any, level: int = 1):
        import xxhash
        import zstandard

        self.stream, self.hash = stream, xxhash.xxh64_intdigest
        self.press = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True).compress
        self.frames: list[tuple[int, int, int]] = []
        self.first: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int | None, np.ndarray]] = []
        self.size = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, ids))
        self.size += len(ids)
        if self.size >= FRAME_TOKENS:
            self.flush()

    def flush(self) -> None:
        if not self.docs:
            return
        head = np.array([(d or 0, d is not None, len(x)) for d, x in self.docs], HEADER)
        data = struct.pack("<Q", len(self.docs)) + head.tobytes() + b"".join(x.tobytes() for _, x in self.docs)
        packed = self.press(data)
        self.stream.write(packed)
        self.frames.append((len(packed), len(data), self.hash(data) & 0xFFFFFFFF))
        self.first.append((int(head["doc_id"][0]), int(head["known"][0]), len(self.docs)))
        self.docs, self.size = [], 0

    def close(self) -> None:
        self.flush()
        directory = b"".join(struct.pack("<qBQ", *x) for x in self.first)
        self.stream.write(struct.pack("<II", SKIPPABLE_DIRECTORY, len(directory)) + directory)
        table = b"".join(struct.pack("<III", *x) for x in [*self.frames, (len(directory) + 8, 0, 0)])
        footer = struct.pack("<IBI", len(self.frames) + 1, 0x80, SEEK_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_SEEK, len(table) + len(footer)) + table + footer)


class FrameReader:
    """Reads one file from a seekable binary stream; frames are decompressed when asked for."""

    def __init__(self, stream: Any, size: int):
        import xxhash
        import zstandard

        self.stream, self.hash, self.open = stream, xxhash.xxh64_intdigest, zstandard.ZstdDecompressor().decompress
        stream.seek(size - 9)
        n, _, magic = struct.unpack("<IBI", stream.read(9))
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table at the end")
        stream.seek(size - 9 - 12 * n)
        table = np.frombuffer(stream.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        offsets = np.concatenate(([0], np.cumsum(table[:, 0])))
        self.frames, self.offsets = table[:-1], offsets[:-2]
        stream.seek(int(offsets[-2]) + 8)
        entries = struct.iter_unpack("<qBQ", stream.read(int(table[-1, 0]) - 8))
        self.first = [(d if known else None, count) for d, known, count in entries]
        self.decompressed = 0

    def frame(self, k: int) -> Iterator[tuple[int | None, np.ndarray]]:
        """The documents of frame k, after its checksum has been compared."""
        packed, size, check = self.frames[k].tolist()
        self.stream.seek(int(self.offsets[k]))
        data = self.open(self.stream.read(packed), max_output_size=size)
        if self.hash(data) & 0xFFFFFFFF != check:
            raise ValueError(f"checksum of frame {k} differs")
        self.decompressed += 1
        n = struct.unpack_from("<Q", data)[0]
        head = np.frombuffer(data, HEADER, n, 8)
        at = 8 + n * HEADER.itemsize
        for doc_id, known, count in head.tolist():
            yield (doc_id if known else None), np.frombuffer(data, "<u4", count, at)
            at += 4 * count

    def documents(self, wanted: list[int] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        """All documents, or those of the ids wanted: only frames whose range holds one are touched."""
        if wanted is None:
            for k in range(len(self.frames)):
                yield from self.frame(k)
            return
        want = np.array(sorted(set(wanted)), np.int64)
        low = [-(2**63) if d is None else d for d, _ in self.first]
        high = [*low[1:], 2**63 - 1]
        for k, (a, b) in enumerate(zip(low, high)):
            if np.searchsorted(want, a, "left") < np.searchsorted(want, b, "right"):
                yield from ((d, x) for d, x in self.frame(k) if d is not None and d in set(wanted))


def write_token_files(
    docs: DataFrame, file: str = "word_bpe_49k.json", end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None
) -> DataFrame:
    """Encode and write all rows; returns the stored manifest (file_no, path, n_docs, n_tokens)."""
    folder = folder or new_folder(docs.sparkSession, "token-files")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        writer = stream = None
        n_docs = n_tokens = 0
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            if writer is None and ids:
                system, path = fs.FileSystem.from_uri(folder)
                system.create_dir(path, recursive=True)
                name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.zst"
                stream = system.open_output_stream(f"{path}/{name}", compression=None)
                writer = FrameWriter(stream)
            for doc_id, tokens in zip(ids, encoded(texts, file, end_id)):
                writer.add(doc_id, tokens)
                n_docs, n_tokens = n_docs + 1, n_tokens + len(tokens)
        if writer is not None:
            writer.close()
            stream.close()
            row = {"file_no": [TaskContext.get().partitionId()], "path": [f"{folder}/{name}"], "n_docs": [n_docs], "n_tokens": [n_tokens]}
            yield pa.RecordBatch.from_pydict(row, pa.schema([("file_no", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    rows = id_and_text(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return stored(ordered.mapInArrow(write, "file_no int, path string, n_docs long, n_tokens long"), "manifest")


def read_token_files(manifest: DataFrame, wanted: list[int] | None = None, with_ids: bool = False) -> DataFrame:
    """Read the files of a manifest back, one task a file: doc_id, in_file, n_tokens, ids_crc32 and the file's number.

    ``in_file`` counts the ids before the document in its file (null where only ``wanted`` documents are read).
    """
    schema = "file_no int, doc_id long, in_file long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        arrow = pa.schema([("file_no", pa.int32()), ("doc_id", pa.int64()), ("in_file", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids)
        for batch in batches:
            for number, uri in zip(batch.column("file_no").to_pylist(), batch.column("path").to_pylist()):
                system, path = fs.FileSystem.from_uri(uri)
                with system.open_input_file(path) as stream:
                    reader = FrameReader(stream, stream.size())
                    rows: list[tuple] = []
                    before = 0
                    for doc_id, ids in reader.documents(wanted):
                        raw = ids.tobytes()
                        rows.append((number, doc_id, before if wanted is None else None, len(ids), zlib.crc32(raw), raw)[: len(arrow)])
                        before += len(ids)
                        if len(rows) >= 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    # a stated number of partitions isn't coalesced, so files are read side by side
    files = manifest.select("file_no", "path").repartition(max(1, manifest.count()), "file_no")
    return files.mapInArrow(read, schema)


def token_index(docs: DataFrame, **options: Any) -> DataFrame:
    """Write the files, read them back, and number the ids over all files: doc_id, start, n_tokens, ids_crc32."""
    manifest = write_token_files(docs, **options)
    before = W.orderBy("file_no").rowsBetween(W.unboundedPreceding, -1)  # one row a file
    starts = manifest.select("file_no", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("file_start"))
    rows = read_token_files(manifest)
    return rows.join(F.broadcast(starts), "file_no").select("doc_id", (F.col("file_start") + F.col("in_file")).alias("start"), "n_tokens", "ids_crc32")
