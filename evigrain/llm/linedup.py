"""Line de-duplication by a deletion-neighbourhood join.

Lines are compared as lower-cased word sequences; the edit bound is one word. A line of n words has
n variants, each without one word. Two lines of equal length whose variants without the word at the
same place are equal differ in that word alone; a line that equals another one's variant lacks one
word of it. So lines are joined on equal hashed keys of (variant, place) and of (variant, whole
line). The pairs that the keys name are read again and their distance is verified word by word. A
line goes if an earlier line, in order of document and line, lies within the bound.

A variant's key comes from the line's polynomial before the word it lacks and the one after it, so
all keys of a line take time in proportion to its words, and no variant is ever built. Keys are
settled in numpy arrays of a fixed number of rows, whatever the lengths of lines and texts.

Short lines emit their variants at once; a long line emits them only if it can have a partner. Two
lines within the bound of which one is long share their first or their last half, so halves are
joined first; a line a word short of a long one gives it its halves too. Long candidates are picked
from the texts by a broadcast bit set of bounded size before they are joined, line by line. Every join
of keys is a grouping of sorted, packed runs: a task sends on a key's earliest line only and settles
its other lines itself, so a key that a third of all lines hold moves one row for each task.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigrain.llm.ngrams import CACHE_WORDS, WordHashes
from evigrain.llm.runs import split_runs, unpack
from evigrain.llm.simhash import other_bits
from evigrain.llm.staging import sieved, staged

MIN_WORDS = 5
LONG_WORDS = 16
#: A task settles what it holds after so many lines or words that emit variants, and so many variants at a time: some 100 bytes each.
HELD_LINES, HELD_WORDS, CHUNK_KEYS = 1 << 17, 1 << 19, 1 << 16
#: Bases of the two polynomials that hash a line from its words' hashes.
BASES = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
SHARD_BITS = 9, 18
ROWS_PER_SHARD = 2000
SIGN = np.uint64(1 << 63)
RUN = "kind string, shard int, blob binary, doc long, line int, keeper_doc long, keeper_line int, distance int"

#: Rows of a grouping: key, check, document, line; documents as unsigned numbers in the same order.
Rows = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _earlier(rows: Rows, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether row a comes before row b."""
    doc, line = rows[2], rows[3]
    return (doc[a] < doc[b]) | ((doc[a] == doc[b]) & (line[a] < line[b]))


def _groups(rows: Rows, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows in order of (key, check, *more, document, line), and where groups of (key, check, *more) begin."""
    order = np.lexsort((rows[3], rows[2], *reversed(more), rows[1], rows[0]))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for x in (rows[0], rows[1], *more):
        new[1:] |= x[order][1:] != x[order][:-1]
    return order, np.flatnonzero(new)


def settle_equal(rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(later, keeper, first)``: of rows with equal keys all but the first go, and only that one needs to be sent on."""
    order, first = _groups(rows)
    leader = np.repeat(order[first], np.diff(np.append(first, len(order))))
    later = _earlier(rows, leader, order)
    return order[later], leader[later], order[first]


def settle_variants(rows: Rows, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As settle_equal, but between whole lines (place -1) and variants of others only.

    Variants without the word at the same place settle among themselves elsewhere, so of each place
    only the first one needs to be sent on.
    """
    whole = place < 0
    order, first = _groups(rows, whole)
    key = np.cumsum(np.isin(np.arange(len(order)), _groups(rows)[1])) - 1  # both orders list groups alike
    lead = np.full((2, len(order)), -1)
    lead[whole[order[first]].astype(int), key[first]] = order[first]
    other = lead[1 - whole[order].astype(int), key]
    later = other >= 0
    later[later] = _earlier(rows, other[later], order[later])
    order_by_place, first_by_place = _groups(rows, place)
    return order[later], other[later], order_by_place[first_by_place]


def partners(rows: Rows) -> tuple[np.ndarray, np.ndarray]:
    """``(met, sent)`` for half keys, whose check tells lines apart: rows whose key has different lines, and those to send on, one or two for each key."""
    order, first = _groups(rows)
    keys = rows[0][order[first]]  # one entry for each line of a key
    outer = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, int)
    lines = np.diff(np.append(outer, len(keys)))
    sizes = np.diff(np.append(first, len(order)))
    met = order[np.repeat(np.repeat(lines > 1, lines), sizes)]
    place = np.arange(len(keys)) - np.repeat(outer, lines)
    return met, order[first[place < 2]]


def _decisions(rows: Rows, later: np.ndarray, keeper: np.ndarray, distance: int) -> pa.RecordBatch:
    n = len(later)
    doc = lambda x: (rows[2][x] ^ SIGN).view(np.int64)
    none = pa.nulls(n, pa.binary())
    return _batch(pa.array(["removed"] * n, pa.string()), pa.nulls(n, pa.int32()), none, doc(later), rows[3][later].astype(np.int32), doc(keeper), rows[3][keeper].astype(np.int32), np.full(n, distance, np.int32))


def _marks(kind: str, rows: Rows, which: np.ndarray) -> pa.RecordBatch:
    n = len(which)
    return _batch(pa.array([kind] * n, pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), (rows[2][which] ^ SIGN).view(np.int64), rows[3][which].astype(np.int32), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()))


def _runs(kind: str, rows: Rows, bits: int, extra: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Packed runs by shard, sorted by key."""
    order = np.argsort(rows[0], kind="stable")
    key, check, doc, line = (x[order] for x in rows)
    values = [check, doc >> np.uint64(32), doc & np.uint64(0xFFFFFFFF), line] + ([extra[order]] if extra is not None else [])
    found = list(split_runs(key, (key >> np.uint64(64 - bits)).astype(np.int64), values))
    n = len(found)
    if n:
        yield _batch(pa.array([kind] * n), pa.array([s for s, _ in found], pa.int32()), pa.array([b for _, b in found], pa.binary()), *(pa.nulls(n, k) for k in (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32())))


def _batch(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=["kind", "shard", "blob", "doc", "line", "keeper_doc", "keeper_line", "distance"])


def _unpacked(blobs: list[bytes], extra: int = 0) -> tuple[Rows, list[np.ndarray]]:
    parts = [unpack(b, 4 + extra) for b in blobs]
    key, check, high, low, line, *more = (np.concatenate([p[i] for p in parts]) for i in range(5 + extra))
    return (key, check, high.astype(np.uint64) << np.uint64(32) | low, line), more


class _Held:
    """Digests gathered from lines until they are settled; texts are never held."""

    def __init__(self):
        self.digests, self.doc, self.line, self.extra = bytearray(), array("q"), array("I"), array("q")

    def add(self, part: bytes, doc: int, line: int, extra: int) -> None:
        self.digests += xxhash.xxh3_128_digest(part)
        self.doc.append(doc)
        self.line.append(line)
        self.extra.append(extra)

    def rows(self) -> Rows:
        found = np.frombuffer(bytes(self.digests), np.uint64).reshape(-1, 2)
        doc = np.array(self.doc, np.int64).view(np.uint64) ^ SIGN
        return found[:, 0].copy(), (found[:, 1] >> np.uint64(32)).astype(np.uint32), doc, np.array(self.line, np.uint32)


class _Words:
    """Hashed words of lines that emit variants."""

    def __init__(self, hashes: WordHashes):
        self.hashes, self.words, self.length, self.doc, self.line, self.of = hashes, array("Q"), array("q"), array("q"), array("I"), array("q")

    def add(self, words: list[bytes], doc: int, line: int, of: int = 0) -> None:
        if len(self.hashes) > CACHE_WORDS:
            self.hashes.clear()
        self.words.extend(map(self.hashes.__getitem__, words))
        self.length.append(len(words))
        self.doc.append(doc)
        self.line.append(line)
        self.of.append(of)

    def variants(self, use: np.ndarray | None = None) -> Iterator[tuple[Rows, np.ndarray]]:
        """Keys of every variant, with the place of the word it lacks, and of the whole lines (place -1), some at a time."""
        length, words = np.array(self.length, np.int64), np.array(self.words, np.uint64)
        doc, line = np.array(self.doc, np.int64).view(np.uint64) ^ SIGN, np.array(self.line, np.uint32)
        if use is not None:
            words = words[np.repeat(use, length)]
            length, doc, line = length[use], doc[use], line[use]
        if not len(length):
            return
        ends = np.cumsum(length)
        place = np.arange(len(words)) - np.repeat(ends - length, length)
        owner = np.repeat(np.arange(len(length)), length)
        sums = [_line_sums(words, place, ends - length, ends, base) for base in BASES]
        yield (*_finished([s[2] for s in sums], length), doc, line), np.full(len(length), -1, np.int64)
        for at in range(0, len(words), CHUNK_KEYS):
            some = slice(at, at + CHUNK_KEYS)
            of = owner[some]
            parts = [before[some] + (total[of] - upto[some]) * inverse for before, upto, total, inverse in sums]
            yield (*_finished(parts, length[of] - 1), doc[of], line[of]), place[some]


def _line_sums(words: np.ndarray, place: np.ndarray, begins: np.ndarray, ends: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.uint64]:
    """Of each word the line's polynomial before it and up to it, of each line the whole one, and the base's inverse; modulo 2**64."""
    powers = np.full(int(place.max()) + 1, base, np.uint64)
    powers[0] = 1
    terms = words * np.multiply.accumulate(powers)[place]
    upto = np.cumsum(terms, dtype=np.uint64)
    start = upto[begins] - terms[begins]
    upto -= np.repeat(start, ends - begins)
    return upto - terms, upto, upto[ends - 1], np.uint64(pow(base, -1, 1 << 64))


def _finished(parts: list[np.ndarray], length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key and check from two polynomials and the number of words."""
    key, check = (other_bits(p ^ length.astype(np.uint64) * np.uint64(base)) for p, base in zip(parts, BASES, strict=True))
    return key, (check >> np.uint64(32)).astype(np.uint32)


def _settled_variants(found: Iterator[tuple[Rows, np.ndarray]], bits: int) -> Iterator[pa.RecordBatch]:
    """Decisions between the variants at hand, and runs of those that have to be sent on."""
    held = list(found)
    for some in (held[i : i + 4] for i in range(0, len(held), 4)):
        rows = tuple(np.concatenate([r[k] for r, _ in some]) for k in range(4))
        place = np.concatenate([p for _, p in some])
        found, first = _settle_places(rows, place)
        yield from found
        yield from _runs("variant", tuple(x[first] for x in rows), bits, place[first] + 1)


def _settle_places(rows: Rows, place: np.ndarray) -> tuple[list[pa.RecordBatch], np.ndarray]:
    """Decisions among variants at the same place, and between variants and whole lines; and the rows to send on, the first of each key and place."""
    part = place >= 0
    mixed = rows[0] ^ ((place + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    same = tuple(x[part] for x in (mixed, *rows[1:]))
    later, keeper, _ = settle_equal(same)
    lacking, whole, first = settle_variants(rows, place)
    return [_decisions(same, later, keeper, 1), _decisions(rows, lacking, whole, 1)], first


def _first_pass(batches: Iterator[pa.RecordBatch], bits: int, shortest: int) -> Iterator[pa.RecordBatch]:
    """Whole lines, the variants of short ones and, of lines that are long or a word short of it, their halves."""
    hashes = WordHashes()
    lines, halves, short = _Held(), _Held(), _Words(hashes)

    def flush() -> Iterator[pa.RecordBatch]:
        rows = lines.rows()
        later, keeper, first = settle_equal(rows)
        yield _decisions(rows, later, keeper, 0)
        yield from _runs("line", tuple(x[first] for x in rows), bits)
        stays = np.zeros(len(rows[0]), bool)
        stays[first] = True
        of = np.array(halves.extra, np.int64)
        use = stays[of] if len(of) else np.empty(0, bool)
        key, _, doc, line = halves.rows()
        rows = key[use], rows[1][of[use]], doc[use], line[use]
        met, sent = partners(rows)
        yield _marks("candidate", rows, met)
        yield from _runs("half", tuple(x[sent] for x in rows), bits)
        yield from _settled_variants(short.variants(stays[np.array(short.of, np.int64)]), bits)
        lines.__init__()
        halves.__init__()
        short.__init__(hashes)

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if doc is None or not text.is_valid:
                continue
            for number, line in enumerate(text.as_py().lower().split(b"\n")):
                words = line.split()
                n = len(words)
                if n < shortest:
                    continue
                if n >= LONG_WORDS - 1:
                    for m in {max(n, LONG_WORDS) // 2, (n + 1) // 2}:
                        halves.add(b"<" + b" ".join(words[:m]), doc, number, len(lines.doc))
                        halves.add(b">" + b" ".join(words[-m:]), doc, number, len(lines.doc))
                if MIN_WORDS <= n < LONG_WORDS:
                    short.add(words, doc, number, len(lines.doc))
                lines.add(b" ".join(words), doc, number, 0)
                if len(lines.doc) > HELD_LINES or len(short.words) > HELD_WORDS:
                    yield from flush()
    yield from flush()


def _second_pass(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Variants of candidate long lines: by place, and as whole lines of others."""
    hashes = WordHashes()
    held = _Words(hashes)
    for batch in batches:
        for doc, number, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            words = line.as_py().encode().lower().split()
            if len(words) >= LONG_WORDS:
                held.add(words, doc, number)
            if len(held.words) > HELD_WORDS:
                yield from _settled_variants(held.variants(), bits)
                held = _Words(hashes)
    yield from _settled_variants(held.variants(), bits)


def _in_shard(key: tuple, runs: pa.Table) -> pa.Table:
    kind, blobs = key[0].as_py(), runs.column("blob").to_pylist()
    rows, extra = _unpacked(blobs, int(kind == "variant"))
    if kind == "half":
        out = [_marks("candidate", rows, partners(rows)[0])]
    elif kind == "line":
        out = [_decisions(rows, *settle_equal(rows)[:2], 0)]
    else:
        out = _settle_places(rows, extra[0].astype(np.int64) - 1)[0]
    return pa.Table.from_batches(out)


def removed_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = MIN_WORDS) -> DataFrame:
    """``(id_col, line_no, keeper_<id_col>, keeper_line_no, distance)``: every line that goes, with an earlier line within ``distance`` (0 or 1 words).

    Lines are parted by line feeds and numbered from 0. Lines with fewer than five words go only
    where an earlier line is equal, and with fewer than ``shortest`` (1 at least) always stay, as
    do blank lines, the lines of null texts and of rows with a null id. Rows with the same id
    count as one document. Other columns aren't read; an empty table gives an empty result.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").cast("binary").alias("text"))
    shortest = max(1, shortest)
    bits = min(SHARD_BITS[1], max(SHARD_BITS[0], math.ceil(math.log2(max(1, df.count() / ROWS_PER_SHARD)))))
    first = staged(docs.mapInArrow(lambda batches: _first_pass(batches, bits, shortest), RUN), "lines")
    settled = staged(first.where("kind in ('line', 'half')").groupBy("kind", "shard").applyInArrow(_in_shard, RUN), "lines")
    candidates = staged(first.unionByName(settled).where("kind = 'candidate'").select("doc", "line").distinct(), "candidates")
    second = _lines(docs, candidates).mapInArrow(lambda batches: _second_pass(batches, bits), RUN)
    second = staged(second, "variants")
    again = first.unionByName(second).where("kind = 'variant'").groupBy("kind", "shard").applyInArrow(_in_shard, RUN)
    found = first.unionByName(settled).unionByName(second).unionByName(again).where("kind = 'removed'")
    found = found.select("doc", "line", "keeper_doc", "keeper_line", "distance").groupBy("doc", "line", "keeper_doc", "keeper_line").agg(F.min("distance").alias("distance"))
    found = staged(found, "pairs")
    exact = found.where("distance = 0").groupBy("doc", "line").agg(F.min(F.struct("keeper_doc", "keeper_line")).alias("k")).select("doc", "line", "k.keeper_doc", "k.keeper_line", F.lit(0).alias("distance"))
    near = verified(docs, staged(found.where("distance = 1").join(exact, ["doc", "line"], "left_anti"), "pairs"))
    near = near.groupBy("doc", "line").agg(F.min(F.struct("keeper_doc", "keeper_line")).alias("k")).select("doc", "line", "k.keeper_doc", "k.keeper_line", F.lit(1).alias("distance"))
    found = exact.unionByName(near)
    return found.select(F.col("doc").alias(id_col), F.col("line").alias("line_no"), F.col("keeper_doc").alias(f"keeper_{id_col}"), F.col("keeper_line").alias("keeper_line_no"), "distance")


def _lines(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(doc, line, words)`` of the lines ``(doc, line)`` in ``wanted``; most other lines aren't shuffled."""
    key = F.xxhash64("doc", "line").alias("key")
    picked = sieved(docs, "doc", wanted.select("doc").distinct())
    every = picked.select("doc", F.posexplode(F.split(F.col("text").cast("string"), "\n", -1)).alias("line", "words"))
    return sieved(every.select("*", key), "key", wanted.select(key)).drop("key").join(wanted, ["doc", "line"])


def one_word_apart(a: list[bytes], b: list[bytes]) -> bool:
    """Whether one word replaced, added or left out makes ``a`` into ``b``."""
    short, at = min(len(a), len(b)), 0
    while at < short and a[at] == b[at]:
        at += 1
    if len(a) == len(b):
        return at < len(a) and a[at + 1 :] == b[at + 1 :]
    longer, other = (a, b) if len(a) > len(b) else (b, a)
    return len(longer) == short + 1 and longer[at + 1 :] == other[at:]


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose lines, read again, are one word apart."""
    both = pairs.select("doc", "line").unionByName(pairs.select(F.col("keeper_doc").alias("doc"), F.col("keeper_line").alias("line")))
    wanted = staged(both.distinct(), "wanted")

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [one_word_apart(a.as_py().encode().lower().split(), b.as_py().encode().lower().split()) for a, b in zip(batch.column(4), batch.column(5), strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:4], names=batch.schema.names[:4]).filter(pa.array(keep, pa.bool_()))

    lines = staged(_lines(docs, wanted), "wanted")
    of = lambda doc, line, words: lines.select(F.col("doc").alias(doc), F.col("line").alias(line), F.col("words").alias(words))
    read = pairs.join(of("doc", "line", "a"), ["doc", "line"]).join(of("keeper_doc", "keeper_line", "b"), ["keeper_doc", "keeper_line"])
    return read.select("doc", "line", "keeper_doc", "keeper_line", "a", "b").mapInArrow(apart, "doc long, line int, keeper_doc long, keeper_line int").distinct()


def drop_lines(df: DataFrame, removed: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = MIN_WORDS) -> DataFrame:
    """``df`` with the removed lines taken out of its texts, other columns as they are.

    A document that lost lines and has none of at least ``shortest`` words left is dropped. With 1
    those are the documents of which nothing but blanks would remain.
    """
    schema, at = df.schema, df.columns.index(text_col)
    key, gone_col = (max(df.columns, key=len) + x for x in (" id", " removed"))  # no column has these names
    lists = removed.groupBy(F.col(id_col).alias(key)).agg(F.collect_set("line_no").alias(gone_col))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, texts = [], []
            for text, gone in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if gone:
                    gone = set(gone)
                    left = [x for i, x in enumerate(text.split("\n")) if i not in gone]
                    keep.append(any(len(x.encode().split()) >= shortest for x in left))
                    texts.append("\n".join(left))
                else:
                    keep.append(True)
                    texts.append(text)
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1]).filter(pa.array(keep, pa.bool_()))

    joined = df.join(lists, df[id_col] == lists[key], "left").drop(key)
    return joined.mapInArrow(cut, schema)
