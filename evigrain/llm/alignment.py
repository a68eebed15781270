"""Alignment of two tokenizers' tokens over the same bytes.

Texts are cut before single spaces between other characters, where tokens of both kinds begin
anew. Two pointers over the cumulative ends of the tokens of new chunks give their groups and
links, and a chunk met again comes from a bounded cache in the worker. Each task packs its
documents into blocks of bounded size: documents keep places in their block's list of different
id pairs. Spark counts the pairs of all blocks, joins the counts back to the blocks' lists, and
hands each block its counts.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigrain.llm.automaton import byte_symbols
from evigrain.llm.runs import pack, unpack
from evigrain.llm.staging import staged

#: Links or documents in a block, from which it is closed; a document is never cut.
BLOCK_LINKS, BLOCK_ROWS = 1 << 18, 1 << 14
SLICE_ROWS = 256
#: Bounds of the worker's cache and of a chunk in it, and the new chunks that are encoded as one text.
CACHE_CHUNKS, CHUNK_CHARS, TOGETHER = 300_000, 64, 1024
MARK = "▁"
#: Where chunks begin: a space between two characters that aren't white space.
CUT = re.compile(r"(?<=\S) (?=\S)")


class PairCoder:
    """Chunks to ``(n_a, n_b, n_groups, groups, pairs)``; None where a side's bytes differ from the chunk's."""

    def __init__(self, byte_json: str, piece_model: bytes):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_str(byte_json)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=piece_model)
        symbols = byte_symbols()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for label, i in self.a.get_vocab().items():
            if all(c in symbols for c in label):
                self.a_bytes[i] = bytes(symbols[c] for c in label)
        self.b_bytes = [self._piece(i) for i in range(self.b.vocab_size())]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side]) for side in (self.a_bytes, self.b_bytes))
        #: Each id with the sign after it: inside a group, then (at the same id, plus the size of the vocabulary) at the end of its side.
        self.a_signed, self.b_signed = (np.array([f"{i}{sign}" for sign in signs for i in range(len(side))], object) for side, signs in ((self.a_bytes, ",|"), (self.b_bytes, ",;")))
        #: Chunks met since the cache was last full, and those of the time before.
        self.known: dict[str, tuple | None] = {}
        self.before: dict[str, tuple | None] = {}

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(MARK, " ").encode()

    def aligned(self, chunks: list[str]) -> list[tuple] | None:
        """Of chunks that follow each other in a text: two pointers go over the cumulative ends of both sides' tokens.

        Each end of either side is a link of the tokens that the pointers are in, each end of both
        cuts a group, and chunks end with a group. None if a side's bytes differ from the text's.
        """
        text = "".join(chunks)
        # the second side adds the space that the first chunk begins with
        ids_a, ids_b = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.b.encode(text[1:])
        whole_bytes = text.encode()
        if any(b"".join(map(side.__getitem__, ids)) != whole_bytes for side, ids in ((self.a_bytes, ids_a), (self.b_bytes, ids_b))):
            return None
        a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        ends_a, ends_b = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        ends = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
        ends = ends[np.append(ends[1:] != ends[:-1], True)]
        i, j = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        pairs = (a[i] << 32 | b[j]).astype("<u8").tobytes()
        cut = np.flatnonzero((ends_a[i] == ends) & (ends_b[j] == ends))
        last_i, last_j = i[cut] + 1, j[cut] + 1
        sizes = [len(c) for c in chunks] if text.isascii() else [len(c.encode()) for c in chunks]
        stops = np.cumsum(sizes)
        whole = np.searchsorted(ends[cut], stops)
        if (ends[cut][whole] != stops).any():
            raise ValueError("tokens cross a space between words")
        # tokens with their signs, group by group: those of the first side, then those of the second
        signed = np.empty(len(a) + len(b), object)
        for ids, last, table, before in ((a, last_i, self.a_signed, np.append(0, last_j[:-1])), (b, last_j, self.b_signed, last_i)):
            at, ending = np.arange(len(ids)), np.zeros(len(ids), bool)
            ending[last - 1] = True
            signed[at + before[np.cumsum(ending) - ending]] = table[ids + len(table) // 2 * ending]
        tokens = signed.tolist()
        stops_i, stops_j, links = last_i[whole], last_j[whole], cut[whole] + 1
        out, g, p, q, r = [], 0, 0, 0, 0
        for h, i, j, k in zip((whole + 1).tolist(), stops_i.tolist(), stops_j.tolist(), links.tolist(), strict=True):
            out.append((i - p, j - q, h - g, "".join(tokens[p + q : i + j])[:-1], pairs[8 * r : 8 * k]))
            g, p, q, r = h, i, j, k
        return out

    def learn(self, chunks: set[str]) -> list[str]:
        """Make sure that all ``chunks`` are known; returns those too long to stay so."""
        if len(self.known) > CACHE_CHUNKS:
            self.known, self.before = {}, self.known
        new = chunks.difference(self.known)
        met = new.intersection(self.before)
        self.known.update((c, self.before[c]) for c in met)
        new = list(new - met)
        plain = [c for c in new if not (c[1:2].isspace() or c[-1].isspace())]
        for at in range(0, len(plain), TOGETHER):
            self._learn(plain[at : at + TOGETHER])
        for chunk in new:
            if chunk not in self.known:
                self._learn([chunk])
        return [c for c in new if len(c) > CHUNK_CHARS]

    def _learn(self, chunks: list[str]) -> None:
        """In halves where a chunk's bytes differ."""
        found = self.aligned(chunks)
        if found is not None or len(chunks) == 1:
            self.known.update(zip(chunks, found or [None], strict=True))
        else:
            self._learn(chunks[: len(chunks) // 2])
            self._learn(chunks[len(chunks) // 2 :])


def chunks_of(text: str) -> list[str]:
    """The space and the text, cut where tokens of both sides begin; none for an empty text."""
    if not text:
        return []
    plain = len(text) == len(" ".join(text.split()))  # white space is single and inside the text
    return [" " + c for c in (text.split(" ") if plain else CUT.split(text))]


RESULT = ["id", "n_a", "n_b", "n_groups", "n_links", "groups"]
SCORED = "id long, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long"
ALIGNED = "block string, id long, n_a long, n_b long, n_groups long, n_links long, groups string, found binary, pairs array<long>, held array<int>"


def align_tokens(df: DataFrame, byte_json: str, piece_model: bytes, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """``(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``, and ``groups`` if asked for.

    Tokens of the byte-level vocabulary (A) over a space and the text, against those of the piece
    vocabulary (B) over the text. Groups are cut at byte offsets where tokens of both end; links are
    all pairs of tokens whose bytes overlap. ``count_sum`` adds over a document's links the number of
    documents that hold the link's id pair, and ``n_best`` counts the links whose number is the
    highest of their A id, ties too. ``groups_sha256`` is of ``a1,a2|b1;a3|b2,b3``.

    One row per input row; repeated rows are documents of their own. Null and empty texts, and texts
    whose bytes a side doesn't keep, have zeros and an empty digest. Texts of any length are aligned
    whole. One text in each slice of 256 is compared with the libraries' tokens of the whole text,
    and a difference ends the job. An empty table gives an empty result; other columns aren't read.
    """
    shared = df.sparkSession.sparkContext.broadcast((byte_json, piece_model))

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PairCoder(*shared.value)
        waiting: list[tuple] = []
        links = 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                ids, texts = part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]
                chunks = [chunks_of(t) for t in texts]
                long = coder.learn(set().union(*chunks))
                sample = min(range(len(texts)), key=lambda i: (not texts[i], len(texts[i])))
                _same(coder, texts[sample], [coder.known[c] for c in chunks[sample]])
                for ident, mine in zip(ids, chunks, strict=True):
                    parts = list(map(coder.known.__getitem__, mine))
                    waiting.append(_document(ident, parts, with_groups) if parts and None not in parts else (ident, 0, 0, 0, 0, "", None, None))
                    links += waiting[-1][4]
                    if links >= BLOCK_LINKS or len(waiting) >= BLOCK_ROWS:
                        yield _block(waiting)
                        waiting, links = [], 0
                for chunk in long:
                    del coder.known[chunk]
        if waiting:
            yield _block(waiting)

    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = staged(texts.mapInArrow(aligned, ALIGNED), "aligned")
    lists = rows.where("pairs is not null").select(F.col("block").alias("its_block"), F.explode(F.arrays_zip("pairs", "held")).alias("x")).select("its_block", F.col("x.pairs").alias("pair"), F.col("x.held").alias("held"))
    counts = staged(lists.groupBy("pair").agg(F.sum("held").alias("count")), "pair-counts")
    #: A row for each id of the byte-level vocabulary at most, so small enough to broadcast.
    top = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("count").alias("top"))
    known = counts.join(F.broadcast(top), F.shiftright("pair", 32) == F.col("a")).select("pair", "count", (F.col("count") == F.col("top")).alias("best"))
    met = lists.join(known, "pair").select("its_block", "pair", "count", "best")
    linked = rows.where("n_links > 0").select("block", "found", *RESULT)
    scored = linked.groupBy("block").cogroup(met.groupBy("its_block")).applyInPandas(_scores, SCORED)
    none = F.lit(0).cast("long")
    both = scored.unionByName(rows.where("n_links = 0").select(*RESULT, none.alias("n_best"), none.alias("count_sum")))
    digest = F.when(F.col("n_links") > 0, F.sha2("groups", 256) if with_groups else F.col("groups")).otherwise("")
    return both.select(F.col("id").alias(id_col), *RESULT[1:5], "n_best", "count_sum", digest.alias("groups_sha256"), *(["groups"] if with_groups else []))


def _same(coder: PairCoder, text: str, parts: list) -> None:
    """The chunks' tokens are those of the whole text."""
    if not text or None in parts:
        return
    whole = coder.aligned([" " + text])
    if whole is None or whole[0][3] != ";".join(p[3] for p in parts):
        raise ValueError("a text's tokens differ from the libraries'")


def _document(ident: int | None, parts: list[tuple], with_groups: bool) -> tuple:
    n_a, n_b, n_groups, texts, found = zip(*parts, strict=True)
    pairs, times = np.unique(np.frombuffer(b"".join(found), "<u8"), return_counts=True)
    groups = ";".join(texts)
    shown = groups if with_groups else hashlib.sha256(groups.encode()).hexdigest()
    return ident, sum(n_a), sum(n_b), sum(n_groups), int(times.sum()), shown, pairs, times


def _block(documents: list[tuple]) -> pa.RecordBatch:
    """Rows of a block's documents; the last one carries the block's different pairs and how many documents hold each."""
    name, n = uuid.uuid4().hex, len(documents)
    held = [d[6] for d in documents if d[6] is not None]
    pairs, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    found = [None if d[6] is None else pack(np.searchsorted(pairs, d[6]).astype(np.uint64), d[7]) for d in documents]
    last = [None] * (n - 1)
    columns = [pa.array([name] * n), *(pa.array([d[i] for d in documents], pa.int64()) for i in range(5)), pa.array([d[5] for d in documents], pa.string())]
    columns += [pa.array(found, pa.binary()), pa.array([*last, pairs.astype(np.int64)] if held else [None] * n, pa.list_(pa.int64())), pa.array([*last, counts.astype(np.int32)] if held else [None] * n, pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays(columns, names="block id n_a n_b n_groups n_links groups found pairs held".split())


def _scores(documents: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    """Counts in the order of their pairs are the block's list, in which the documents' places are."""
    counts = counts.sort_values("pair")
    count, best = counts["count"].to_numpy(np.int64), counts["best"].to_numpy(bool)
    found = [[x.astype(np.int64) for x in unpack(blob, 1)] for blob in documents["found"]]
    sums = {"n_best": [int(times[best[at]].sum()) for at, times in found], "count_sum": [int((times * count[at]).sum()) for at, times in found]}
    return documents[RESULT].assign(**sums)
