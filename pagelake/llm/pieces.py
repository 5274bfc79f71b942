"""Encoding and decoding by a table of distinct marked words.

A space becomes the marker U+2581 and the text gets one in front. No piece of
the model has a marker after another character, so merges never leave a marked
word (its run of markers and the characters up to the next one). Each distinct
marked word is segmented once by the library, and a text's ids are the words'
ids joined in the order of their positions. Decoding goes by the same table.

Null text is empty (only the end id); repeated rows keep one result row each.
"""

from __future__ import annotations

import functools
import hashlib
import re

from pyspark.sql import DataFrame

from .common import id_and_text, map_texts, tokenizer_path

MARK = "▁"
#: Marked words remembered by one worker; beyond it the table starts afresh.
TABLE_ENTRIES = 500_000
WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class WordTable:
    """marked word without its first marker -> its ids, joined by spaces."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.vocab_size()
        self.names = [str(i) for i in range(size)]
        self.pieces = [self.model.id_to_piece(i) for i in range(size)]
        crossing = re.compile(f"[^{MARK}]{MARK}")
        if any(map(crossing.search, self.pieces)):
            raise ValueError("a piece crosses a marker; words can't be segmented apart")
        self.ids: dict[str, str] = {}
        #: Decoded text of the words whose pieces don't spell them (those with bytes, say).
        self.odd: dict[str, str] = {}
        self.end = f" {self.model.eos_id()}"

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.ids]
        if len(self.ids) + len(new) > TABLE_ENTRIES:
            self.ids.clear()
            self.odd.clear()
            new = list(words)
        name, piece = self.names.__getitem__, self.pieces.__getitem__
        for word, ids in zip(new, self.model.encode(new, num_threads=1) if new else []):
            ids = ids or [self.model.piece_to_id(MARK)]
            self.ids[word] = " ".join(map(name, ids))
            if "".join(map(piece, ids)) != MARK + word:
                plain, got = word.replace(MARK, " "), self.model.decode(ids)
                if got != plain:
                    self.odd[word] = got

    @staticmethod
    def words(text: str) -> list[str]:
        if not text:
            return []
        if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
            return [w[1:] for w in WORDS.findall(MARK + text.replace(" ", MARK))]
        return text.split(" ")

    def encode(self, words: list[str]) -> tuple[str, int, str]:
        """(ids with the end id as text, their number, decoded text) of one text's words."""
        ids = " ".join(map(self.ids.__getitem__, words)) + self.end
        decoded = words
        if self.odd and not self.odd.keys().isdisjoint(words):
            decoded = [self.odd.get(w, w) for w in words]
        return ids.lstrip(), ids.count(" ") + bool(words), " ".join(decoded).replace(MARK, " ")


@functools.lru_cache(maxsize=2)
def table(file: str) -> WordTable:
    return WordTable(tokenizer_path(file))


def encode_pieces(
    docs: DataFrame, file: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text", digest: bool = False
) -> DataFrame:
    """(doc_id, n_tokens, ids string, decoded string), or with ``digest`` the sha256 of the last two."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def rows(texts: list[str]) -> dict[str, list]:
        t = table(file)
        out: dict[str, list] = {"n_tokens": [], "a": [], "b": []}
        for at in range(0, len(texts), 64):
            words = [t.words(x) for x in texts[at : at + 64]]
            t.learn(set().union(*words))
            for w in words:
                ids, n, decoded = t.encode(w)
                out["n_tokens"].append(n)
                out["a"].append(sha(ids) if digest else ids)
                out["b"].append(sha(decoded) if digest else decoded)
        return out

    made = map_texts(id_and_text(docs, id_col, text_col), rows, "n_tokens long, a string, b string")
    names = ("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded")
    return made.withColumnsRenamed({"a": names[0], "b": names[1]})
