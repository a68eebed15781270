"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text's symbols are merged by an agenda of adjacent pairs in order of score, the leftmost first
among equals. No piece holds a word mark after another character, nor a line feed, so merges never
cross those places: each word is merged on its own, and a word met again comes from a bounded cache
in the worker. The agendas of many new words are worked off together as a matrix; very long words
have a heap of their own. In every slice of an Arrow batch a whole text is checked against the
sentencepiece library, and a difference ends the job.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
CACHE_WORDS = 250_000
SLICE_ROWS = 256
NONE = np.iinfo(np.int32).max


class MergeVocabulary:
    """The pieces, scores and special ids of a model, and the agenda over them."""

    def __init__(self, processor):
        size = processor.vocab_size()
        self.ids, self.scores, self.bytes = {}, {}, {}
        for i in range(size):
            piece = processor.id_to_piece(i)
            if processor.is_unused(i):
                raise ValueError("vocabularies with unused pieces aren't supported")
            if processor.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not processor.is_control(i) and not processor.is_unknown(i):
                self.ids[piece], self.scores[piece] = i, processor.get_score(i)
        if any(MARK in p.lstrip(MARK) or ("\n" in p and len(p) > 1) for p in self.ids):
            raise ValueError("pieces that cross word marks or line feeds aren't supported")
        self.unknown = processor.unk_id()
        self._pair_table()

    def _pair_table(self) -> None:
        """Codes of characters, and for each pair of codes that forms a piece its rank by score."""
        self.size = max(self.ids.values()) + 1
        self.codes = np.arange(0x110000, dtype=np.int64) + self.size  # of characters that are no piece
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.codes[ord(piece)] = i
        _, ranks = np.unique([-x for x in self.scores.values()], return_inverse=True)
        pairs = {}
        for (piece, i), rank in zip(self.ids.items(), ranks.tolist(), strict=True):
            for cut in range(1, len(piece)):
                a, b = piece[:cut], piece[cut:]
                left, right = (self.ids.get(x, int(self.codes[ord(x)]) if len(x) == 1 else None) for x in (a, b))
                if left is not None and right is not None:
                    pairs[left << 32 | right] = (rank, i)
        self.keys = np.array(sorted(pairs), np.int64)
        self.rank, self.made = (np.array([pairs[k][n] for k in self.keys.tolist()], np.int32) for n in (0, 1))

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair; rank NONE where it forms no piece."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        good = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(good, self.rank[at], NONE), self.made[at]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Packed ids of each word. The agenda of many words is a matrix with a row for each word and a
        column for each adjacent pair; every step takes each row's best pair, the leftmost among equals."""
        out: list[bytes] = [b""] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        low = 0
        for high in (6, 9, 13, 20, 40):
            rows = np.flatnonzero((lengths > low) & (lengths <= high))
            for at in range(0, len(rows), 1 << 14):
                self._merge_rows(words, rows[at : at + (1 << 14)], lengths, high, out)
            low = high
        for row in np.flatnonzero(lengths > low).tolist():
            ids = self.encode(words[row])
            out[row] = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def _merge_rows(self, words: list[str], rows: np.ndarray, lengths: np.ndarray, width: int, out: list[bytes]) -> None:
        n, size = len(rows), lengths[rows]
        points = np.frombuffer("".join([words[i] for i in rows.tolist()]).encode("utf-32-le"), np.uint32)
        symbols = np.full((n, width + 1), -1, np.int64)
        symbols[:, :width][np.arange(width) < size[:, None]] = self.codes[points]
        rank, made = self._look_up(symbols[:, :-1], symbols[:, 1:])
        column, live = np.arange(width), np.arange(n)
        all_symbols = symbols.copy()
        while len(live):
            best = rank.argmin(axis=1)
            here = np.arange(len(best))
            more = rank[here, best] != NONE
            if not more.all():
                all_symbols[live[~more]] = symbols[~more]
                live, symbols, rank, made, best = live[more], symbols[more], rank[more], made[more], best[more]
                here = np.arange(len(best))
                if not len(live):
                    break
            symbols[here, best] = made[here, best]
            moved = np.minimum(column + (column > best[:, None]), width)
            symbols[:, :width] = np.take_along_axis(symbols, moved, axis=1)
            symbols[:, width] = -1
            moved = np.minimum(column + (column > best[:, None]), width - 1)
            rank, made = np.take_along_axis(rank, moved, axis=1), np.take_along_axis(made, moved, axis=1)
            rank[:, -1] = NONE
            rank[here, best], made[here, best] = self._look_up(symbols[here, best], symbols[here, best + 1])
            before = best > 0
            r, c = here[before], best[before] - 1
            rank[r, c], made[r, c] = self._look_up(symbols[r, c], symbols[r, c + 1])
        kept = (all_symbols >= 0).sum(axis=1)
        odd = (all_symbols >= self.size).any(axis=1)
        packed = all_symbols.astype("<u4")
        for k, (row, count, unknown) in enumerate(zip(rows.tolist(), kept.tolist(), odd.tolist(), strict=True)):
            if unknown:
                ids = self.encode(words[row])
                out[row] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                out[row] = packed[k, :count].tobytes()

    def merge(self, text: str) -> list[str]:
        """The symbols of ``text`` when no pair of neighbours forms a piece any more."""
        n, scores, symbols = len(text), self.scores, list(text)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            if (score := scores.get(text[i : i + 2])) is not None:
                agenda.append((-score, i, i + 1, 2))
        heapify(agenda)
        while agenda:
            _, i, j, size = heappop(agenda)
            if not symbols[i] or not symbols[j] or len(symbols[i]) + len(symbols[j]) != size or right[i] != j:
                continue
            symbols[i] += symbols[j]
            symbols[j] = ""
            after = right[i] = right[j]
            if after < n:
                left[after] = i
                if (score := scores.get(symbols[i] + symbols[after])) is not None:
                    heappush(agenda, (-score, i, after, len(symbols[i]) + len(symbols[after])))
            before = left[i]
            if before >= 0 and (score := scores.get(symbols[before] + symbols[i])) is not None:
                heappush(agenda, (-score, before, i, len(symbols[before]) + len(symbols[i])))
        return [s for s in symbols if s]

    def encode(self, text: str) -> list[int]:
        out = []
        for symbol in self.merge(text):
            if (i := self.ids.get(symbol)) is not None:
                out.append(i)
            elif self.bytes:
                out.extend(self.bytes[b] for b in symbol.encode())
            else:
                out.append(self.unknown)
        return out


class WordCache(dict):
    """Word to its ids as little-endian 32-bit integers; words are merged in batches before they are looked up."""

    def __init__(self, vocabulary: MergeVocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def learn(self, words: set[str]) -> None:
        """Make sure that all ``words`` are in the cache; it is emptied first if it has grown too large."""
        if len(self) > CACHE_WORDS:
            self.clear()
        new = list(words.difference(self))
        self.update(zip(new, self.vocabulary.encode_words(new), strict=True))


def words_of(text: str) -> list[str]:
    """The normalised text in parts between which no merge can take place, in order."""
    if not text:
        return []
    out: list[str] = []
    for number, line in enumerate(text.replace(MARK, " ").split("\n")):
        if number:
            out.append("\n")
            first, *rest = line.split(" ")
            if first:
                out.append(first)
        else:
            rest = line.split(" ")
        marks = MARK
        for word in rest:
            if word:
                out.append(marks + word)
                marks = MARK
            else:
                marks += MARK
        if len(marks) > 1:
            out.append(marks[1:])
    return out


def encode_documents(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_tokens, ids, decoded)``: begin id, pieces, end id as little-endian unsigned 32-bit integers, and the library's decoding of them.

    One row per input row, repeated ones too. A null text counts as empty, which has the begin and
    the end id; texts of any length are encoded whole. Other columns of ``df`` aren't read; an
    empty table gives an empty result.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sentencepiece import SentencePieceProcessor

        processor = SentencePieceProcessor(model_proto=shared.value)
        cache = WordCache(MergeVocabulary(processor))
        begin, end = (struct.pack("<I", i) for i in (processor.bos_id(), processor.eos_id()))
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                texts = [t or "" for t in part.column(1).to_pylist()]
                words = [words_of(t) for t in texts]
                cache.learn(set().union(*words))
                ids = [begin + b"".join(map(cache.__getitem__, w)) + end for w in words]
                numbers = [np.frombuffer(x, "<u4").tolist() for x in ids]
                if numbers[0] != processor.encode(texts[0], add_bos=True, add_eos=True):
                    raise ValueError("a text's ids differ from the library's")
                counts = pa.array([len(x) for x in numbers], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), counts, pa.array(ids, pa.binary()), pa.array(processor.decode(numbers), pa.string())], names=[id_col, "n_tokens", "ids", "decoded"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(encoded, f"`{id_col}` long, n_tokens long, ids binary, decoded string")
