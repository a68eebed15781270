"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays.

A word is the upper half of the XXH64 of its bytes; a bigram is two such halves in one 64-bit key.
Each task counts its texts' bigrams and words and sends them on as packed, sorted runs, one for each
shard; a shard is a range of first words, and the bigrams of words that are frequent in a bounded
sample are spread over further shards by their second word. Shards add up the runs and write sorted
arrays to the shared folder. Scoring tasks map those arrays into memory and join the sorted keys of
a slice of texts with them, shard by shard. Neither counting nor scoring holds a whole table
anywhere, and the sample has no influence on the counts.
"""

from __future__ import annotations

import math
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigrain.llm.runs import split_runs, unpack
from evigrain.llm.staging import new_path, staged

SHARD_BITS = 8, 20
ROWS_PER_SHARD = 2000
SALT_BITS = 6
HOT_SHARE = 0.01
HOT_SAMPLE_DOCS = 500
SLICE_TOKENS = 1 << 20
HELD_KEYS = 4 << 20
CACHE_WORDS = 300_000
#: White space is in no word, so these stand for the begin and the end of a text alone.
BEGIN, END = (xxhash.xxh64_intdigest(x, 0) for x in (b"\t", b"\n"))
HALF = np.uint64(32)


class WordHashes(dict):
    """Word to its 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh64_intdigest(word, 0)
        return found

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Begin, words and end of each text, one text after the other, and where each begins."""
        if len(self) > CACHE_WORDS:
            self.clear()
        words = [t.lower().split() for t in texts]
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
        starts = np.cumsum(lengths) - lengths
        out = np.empty(int(lengths.sum()), np.uint64)
        inner = np.ones(len(out), bool)
        inner[starts] = inner[starts + lengths - 1] = False
        out[starts], out[starts + lengths - 1] = BEGIN, END
        out[inner] = np.fromiter(map(self.__getitem__, (w for ws in words for w in ws)), np.uint64, int(inner.sum()))
        return out, starts


def slices(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Texts as UTF-8 (null: empty), a bounded number of bytes at a time, with the first one's place."""
    held, size, first = [], 0, 0
    for at, text in enumerate(column):
        value = text.as_py()
        held.append(b"" if value is None else value)
        size += len(held[-1])
        if size > 6 * SLICE_TOKENS:
            yield first, held
            held, size, first = [], 0, at + 1
    if held:
        yield first, held


def add_up(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys, sorted, with the sums of their values."""
    if not len(keys):
        return [keys, *values]
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return [keys[first]] + [np.add.reduceat(v[order].astype(np.int64), first) for v in values]


def merged(blobs: list[bytes], values: int) -> list[np.ndarray]:
    parts = [unpack(b, values) for b in blobs]
    return add_up(*(np.concatenate([p[i] for p in parts]) for i in range(values + 1)))


def shard_bits(rows: int) -> int:
    """So many shards, as a power of two, that each has the words of about as many rows."""
    return min(SHARD_BITS[1], max(SHARD_BITS[0], math.ceil(math.log2(max(1, rows / ROWS_PER_SHARD)))))


def top_bits(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def shard_of(keys: np.ndarray, hot: np.ndarray, bits: int) -> np.ndarray:
    """A key's shard: the top bits of its first word, or for a hot word the word's place and the top bits of the second."""
    first = (keys >> HALF).astype(np.uint32)
    shard = top_bits(keys, bits)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, first), len(hot) - 1)
        spread = (keys << HALF >> np.uint64(64 - SALT_BITS)).astype(np.int64)
        shard = np.where(hot[at] == first, (1 << bits) + (at << SALT_BITS) + spread, shard)
    return shard


def _by_shard(keys: np.ndarray, shards: np.ndarray, kind: str, *values: np.ndarray) -> Iterator[tuple]:
    return ((kind, shard, blob) for shard, blob in split_runs(keys, shards, list(values)))


def _runs(rows: list[tuple]) -> pa.RecordBatch:
    kind, shard, blob = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(shard, pa.int32()), pa.array(blob, pa.binary())], names=["kind", "shard", "blob"])


def _file(path: str, name: str) -> tuple[fs.FileSystem, str]:
    files, root = fs.FileSystem.from_uri(path)
    return files, f"{root}/{name}"


def _write(path: str, kind: str, shard: int, keys: np.ndarray, *values: np.ndarray) -> None:
    """A shard's file: its sorted keys, then each of its values. A repeated task writes the same bytes, and a complete file takes the place of another."""
    files, target = _file(path, f"{kind}-{shard}")
    files.create_dir(target.rsplit("/", 1)[0], recursive=True)
    part = f"{target}.{uuid.uuid4().hex}"
    with files.open_output_stream(part) as out:
        out.write(keys.tobytes())
        for v in values:
            out.write(v.astype(VALUES[kind][1]).tobytes())
    files.move(part, target)


#: Number and type of the values that are stored with the keys of each kind; pairs' counts are exact to 2**24.
VALUES = {"pair": (1, np.float32), "word": (1, np.uint64), "context": (4, np.uint64), "follow": (1, np.uint32)}


#: A scoring task keeps the arrays of so many shards open, the ones used last.
OPEN_ARRAYS = 512


class Arrays:
    """Each shard's keys and values, mapped into memory where the folder is mounted, else read."""

    def __init__(self, path: str):
        self.path, self.there = path, OrderedDict()

    def get(self, kind: str, shard: int) -> list[np.ndarray]:
        if (kind, shard) not in self.there:
            files, target = _file(self.path, f"{kind}-{shard}")
            info = files.get_file_info(target)
            if info.type == fs.FileType.NotFound or not info.size:
                raw = np.empty(0, np.uint8)
            elif isinstance(files, fs.LocalFileSystem):
                raw = np.memmap(target, np.uint8, mode="r")
            else:
                with files.open_input_stream(target) as f:
                    raw = np.frombuffer(f.read(), np.uint8)
            values, dtype = VALUES[kind]
            size = np.dtype(dtype).itemsize
            n = len(raw) // (8 + size * values)
            parts = (raw[(8 + size * i) * n : (8 + size * (i + 1)) * n].view(dtype) for i in range(values))
            self.there[kind, shard] = [raw[: 8 * n].view(np.uint64), *parts]
            if len(self.there) > OPEN_ARRAYS:
                self.there.popitem(last=False)
        self.there.move_to_end((kind, shard))
        return self.there[kind, shard]

    def join(self, kind: str, keys: np.ndarray, shards: np.ndarray) -> list[np.ndarray]:
        """For each key the values stored with it, 0 where there are none; keys are sorted within their shard."""
        out = [np.zeros(len(keys), VALUES[kind][1]) for _ in range(VALUES[kind][0])]
        order = np.argsort(shards, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(shards[order])) + 1) if len(order) else ():
            stored, *values = self.get(kind, int(shards[rows[0]]))
            if len(stored):
                at = np.minimum(np.searchsorted(stored, keys[rows]), len(stored) - 1)
                hit = stored[at] == keys[rows]
                for column, value in zip(out, values, strict=True):
                    column[rows[hit]] = value[at[hit]]
        return out


@dataclass
class KneserNey:
    """A trained model: where its arrays are, and its totals."""

    path: str
    tokens: int
    distinct: int
    pairs: int
    pair_discount: tuple[float, float, float]
    word_discount: tuple[float, float, float]
    word_gamma: float
    hot: np.ndarray
    bits: int


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three modified Kneser-Ney discounts from counts of counts; where those are too few, 0.5, 1 and 1.5."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(d if 0 < d < k else k / 2 for k, d in enumerate(found, 1))


def _counts_of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


_RUN = "kind string, shard int, blob binary"
_STATS = "kind string, shard int, blob binary, n long, total long, n1 long, n2 long, n3 long, n4 long"


def _stats(rows: list[tuple]) -> pa.Table:
    kinds = [pa.string(), pa.int32(), pa.binary()] + [pa.int64()] * 6
    names = ["kind", "shard", "blob", "n", "total", "n1", "n2", "n3", "n4"]
    columns = list(zip(*rows, strict=True))
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def hot_words(texts: DataFrame) -> np.ndarray:
    """Words with at least ``HOT_SHARE`` of the words of a few documents, the ones with the lowest hashes; they only decide how bigrams are spread."""
    rows = [r[0] for r in texts.select(F.xxhash64("text").alias("key"), F.substring("text", 1, 4000).alias("part")).orderBy("key").limit(HOT_SAMPLE_DOCS).select("part").collect()]
    words, _ = WordHashes().of([(t or "").encode() for t in rows])
    found, counts = np.unique((words >> HALF).astype(np.uint32), return_counts=True)
    return found[counts >= max(2, HOT_SHARE * len(words))]


def train(texts: DataFrame) -> KneserNey:
    """Count all rows of ``texts`` (column ``text``) and write the model's arrays to the shared folder."""
    path, hot, bits = new_path(texts.sparkSession, "ngrams"), hot_words(texts), shard_bits(texts.count())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size = WordHashes(), {"pair": [], "word": []}, 0

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, parts in held.items():
                if parts:
                    keys, counts = add_up(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
                    shards = shard_of(keys, hot, bits) if kind == "pair" else top_bits(keys, bits)
                    yield _runs(list(_by_shard(keys, shards, kind, counts)))
                parts.clear()

        for batch in batches:
            for _, part in slices(batch.column(0)):
                words, starts = hashes.of(part)
                codes = words >> HALF
                pairs = codes[:-1] << HALF | codes[1:]
                inside = np.ones(len(pairs), bool)
                inside[starts[1:] - 1] = False  # from one text's end to the next one's begin
                tokens = np.ones(len(words), bool)
                tokens[starts] = False
                held["pair"].append(np.unique(pairs[inside], return_counts=True))
                held["word"].append(np.unique(words[tokens], return_counts=True))
                size += len(held["pair"][-1][0]) + len(held["word"][-1][0])
                if size > HELD_KEYS:
                    yield from flush()
                    size = 0
        yield from flush()

    def summed(key: tuple, runs: pa.Table) -> pa.Table:
        kind, shard = key[0].as_py(), key[1].as_py()
        keys, counts = merged(runs.column("blob").to_pylist(), 1)
        _write(path, kind, shard, keys, counts)
        rows = [(kind, shard, b"", len(keys), int(counts.sum()), *_counts_of_counts(counts))]
        if kind == "pair":
            first, second = keys >> HALF, keys & np.uint64(0xFFFFFFFF)
            words, total, *kinds = add_up(first, counts, counts == 1, counts == 2, counts >= 3)
            context = words, total & 0xFFFFFFFF, total >> 32, *kinds
            for name, parts in (("context", context), ("follow", add_up(second, np.ones(len(keys))))):
                words = parts[0] << HALF
                rows += [(k, s, b, 0, 0, 0, 0, 0, 0) for k, s, b in _by_shard(words, top_bits(words, bits), name, *parts[1:])]
        return _stats(rows)

    def by_word(key: tuple, runs: pa.Table) -> pa.Table:
        kind, shard = key[0].as_py(), key[1].as_py()
        keys, *values = merged(runs.column("blob").to_pylist(), 5 if kind == "context" else 1)
        if kind == "context":
            values = [values[0] + (values[1] << 32), *values[2:]]
        _write(path, kind, shard, keys, *values)
        return _stats([(kind, shard, b"", len(keys), int(values[0].sum()), *_counts_of_counts(values[0]))])

    runs = texts.select(F.col("text").cast("string").cast("binary")).mapInArrow(counted, _RUN)
    first = staged(runs.groupBy("kind", "shard").applyInArrow(summed, _STATS), "counts")
    second = staged(first.where("kind in ('context', 'follow')").select("kind", "shard", "blob").groupBy("kind", "shard").applyInArrow(by_word, _STATS), "counts")
    totals = first.where("kind in ('pair', 'word')").unionByName(second).groupBy("kind").agg(*(F.sum(c).alias(c) for c in ("n", "total", "n1", "n2", "n3", "n4")))
    of = {r["kind"]: r for r in totals.drop("blob", "shard").collect()}
    zero = {k: 0 for k in ("n", "total", "n1", "n2", "n3", "n4")}
    pair, word, follow = (of.get(k) or zero for k in ("pair", "word", "follow"))
    pair_discount, word_discount = (discounts(*(x[f"n{i}"] for i in (1, 2, 3, 4))) for x in (pair, follow))
    more = follow["n"] - follow["n1"] - follow["n2"]
    gamma = (word_discount[0] * follow["n1"] + word_discount[1] * follow["n2"] + word_discount[2] * more) / follow["total"] if follow["total"] else 1.0
    return KneserNey(path, word["total"], word["n"], pair["n"], pair_discount, word_discount, gamma, hot, bits)


def _less(counts: np.ndarray, discount: tuple[float, float, float]) -> np.ndarray:
    table = np.array([0.0, *discount])
    return np.maximum(0.0, counts - table[np.minimum(counts, 3).astype(np.int64)])


def score_slice(model: KneserNey, arrays: Arrays, hashes: WordHashes, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: number of tokens, of known ones, base score, and log10 probability."""
    words, starts = hashes.of(texts)
    tokens = np.ones(len(words), bool)
    tokens[starts] = False
    distinct, back = np.unique(words, return_inverse=True)
    top = top_bits(distinct, model.bits)
    (count,) = arrays.join("word", distinct, top)
    code = distinct >> HALF << HALF
    total, n1, n2, n3 = arrays.join("context", code, top)
    (follow,) = arrays.join("follow", code, top)
    low = _less(follow.astype(float), model.word_discount) / max(1, model.pairs) + model.word_gamma / (model.distinct + 1)
    d1, d2, d3 = model.pair_discount
    seen = np.maximum(total, 1).astype(float)
    gamma = np.where(total > 0, (d1 * n1 + d2 * n2 + d3 * n3) / seen, 1.0)
    at = np.flatnonzero(tokens)
    left, right = back[at - 1], back[at]
    keys, pair_back = np.unique(distinct[left] >> HALF << HALF | distinct[right] >> HALF, return_inverse=True)
    (pairs,) = arrays.join("pair", keys, shard_of(keys, model.hot, model.bits))
    p = _less(pairs.astype(float), model.pair_discount)[pair_back] / seen[left] + gamma[left] * low[right]
    base = np.log10((count + 0.1) / (model.tokens + 0.1 * (model.distinct + 1)))
    cuts = starts - np.arange(len(starts))  # of the tokens, without the begins
    sums = lambda x: np.add.reduceat(x, cuts)
    return np.diff(np.append(cuts, len(at))), sums((count[right] > 0).astype(np.int64)), sums(base[right]), sums(np.log10(p))


def score(df: DataFrame, model: KneserNey, keep: list[Column], text: Column) -> DataFrame:
    """The columns ``keep`` of every row with ``n_tokens, n_known, base_score, score`` of its text."""
    wanted = df.select(*keep, F.coalesce(text.cast("string"), F.lit("")).cast("binary").alias("text to score"))
    schema = wanted.drop("text to score").schema

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays, hashes = Arrays(model.path), WordHashes()
        for batch in batches:
            for first, texts in slices(batch.column(batch.num_columns - 1)):
                part = batch.slice(first, len(texts))
                found = score_slice(model, arrays, hashes, texts)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *map(pa.array, found)], names=[*part.schema.names[:-1], "n_tokens", "n_known", "base_score", "score"])

    for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("base_score", "double"), ("score", "double")):
        schema = schema.add(name, kind)
    return wanted.mapInArrow(scored, schema)


def score_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10) -> DataFrame:
    """Train on the rows whose crc32 of the id, as text, leaves a remainder by ``folds``, and score all rows.

    Returns ``(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score)``, a row for
    each input row; scores are log10 probabilities of the words and the end of the text. A null id
    counts as the empty text, so it is held out; null and empty texts are an end alone; with no
    rows to learn from, every token is unknown; an empty table gives an empty result.
    """
    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), fold.alias("held_out"))
    model = train(rows.where("not held_out").select("text"))
    scored = score(rows, model, [F.col("id"), F.col("held_out")], F.col("text"))
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
