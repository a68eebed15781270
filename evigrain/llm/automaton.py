"""BPE encoding and decoding by a deterministic automaton over tokens.

The automaton accepts the token sequences that the merges give, and no others. It begins with one
state and an arc for each base symbol. The gadget of a merge (u, v) -> w, taken in order, copies the
state that u leads to without its arc v, leads every arc u to the copy, and adds an arc w wherever
there is an arc u; w leads where v led. Where u is v the copy has no arc w either, as the leftmost
pair goes first. So a state belongs to the last token read, and only what it lacks against the
state it was copied from is stored: the merges whose left part is its token. All else is found at
the state of the token's right part, as it was when the token was made. The alphabet is fixed, so
the tables grow with the vocabulary and not with the texts.

Of all ways to cut a word into tokens exactly one is a path of the automaton, for every beginning
of the word too. Encoding follows the table's arcs along the word, in time that grows with its length;
decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of the caches in a worker, and the longest chunk that is kept there.
CACHE_WORDS, CACHE_CHUNKS, CACHE_ARCS, CHUNK_CHARS = 400_000, 100_000, 500_000, 64
SLICE_ROWS = 256
FOREVER = 1 << 62
SHORT = (2, 1)
#: Before the string of an added token, which so is no word.
ADDED = "\0"
CHUNKS = re.compile("[^ \t-\r]+").findall
#: A normaliser and a split whose work on texts below U+0250 without control characters is known: lower case alone, and ``LATIN_SPLIT``.
LATIN_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
LATIN_PRETOKENIZER = [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
LATIN = sorted({x for c in range(0x250) for x in chr(c).lower()})
LETTERS, NUMBERS = ("".join(x for x in LATIN if unicodedata.category(x)[0] == kind) for kind in "LN")
LATIN_SPLIT = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{LETTERS}]+|[{NUMBERS}]|[^{LETTERS}{NUMBERS}\\t-\\r \x85\xa0]+").findall
BEYOND_LATIN = re.compile("[\x00-\x08\x0e-\x1f\x7f\u0250-\U0010ffff]").search


def compile_merges(tokenizer: dict) -> dict:
    """The automaton's tables, plain values alone: ``labels`` by id, ``left``, ``right`` and ``made`` (the
    merge's number, -1 for base symbols) by id, ``lacks`` by pair, ``live`` by id, ``suffix``."""
    model = tokenizer["model"]
    for name in ("unk_token", "continuing_subword_prefix", "dropout"):
        if model.get(name):
            raise ValueError(f"vocabularies with {name} aren't supported")
    if model.get("byte_fallback") or model.get("ignore_merges"):
        raise ValueError("vocabularies with byte fallback or whole-word look-up aren't supported")
    ids = model["vocab"]
    size = max([*ids.values(), *(t["id"] for t in tokenizer.get("added_tokens", []))], default=-1) + 1
    labels: list = [None] * size
    for label, i in ids.items():
        labels[i] = label
    for token in tokenizer.get("added_tokens", []):
        labels[token["id"]] = token["content"]
    tables = {"labels": labels, "left": [-1] * size, "right": [-1] * size, "made": [-1] * size, "lacks": {}, "live": [True] * size, "suffix": model.get("end_of_word_suffix") or "", "size": size}
    arcs = Arcs(tables, 0)
    for number, merge in enumerate(model["merges"]):
        u, v = (ids[x] for x in (merge if isinstance(merge, list) else merge.split(" ")))
        w = ids[labels[u] + labels[v]]
        if tables["made"][w] >= 0:
            raise ValueError("two merges make the same token")
        tables["live"][w] = arcs.leads(u, v)
        tables["left"][w], tables["right"][w], tables["made"][w] = u, v, number
        tables["lacks"][u * size + v] = number
    return tables


class Arcs:
    """Transitions: whether the state of token ``s`` has an arc ``t``. The state it leads to is that of ``t``."""

    def __init__(self, tables: dict, remembered: int = CACHE_ARCS):
        self.left, self.right, self.made, self.lacks, self.live, self.size = (tables[k] for k in ("left", "right", "made", "lacks", "live", "size"))
        self.known: dict[int, bool] = {}
        self.remembered = remembered

    def leads(self, s: int, t: int) -> bool:
        key = s * self.size + t
        found = self.known.get(key)
        if found is None:
            found = self._look_up(s, t)
            if len(self.known) < self.remembered:
                self.known[key] = found
        return found

    def _look_up(self, s: int, t: int) -> bool:
        if not (self.live[s] and self.live[t]):
            return False
        before = FOREVER
        while True:
            if self.lacks.get(s * self.size + t, FOREVER) < before:
                return False
            new_s, new_t = self.made[s], self.made[t]
            if new_t > new_s:  # arc t was added wherever its left part was an arc, once the gadget's copy was made
                before, t = min(before, new_t + 1), self.left[t]
            elif new_s >= 0:  # the state was a copy of its right part's
                before, s = new_s, self.right[s]
            else:
                return True


def byte_symbols() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: printable ones for themselves, others in order from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbols = {chr(b): b for b in plain}
    return symbols | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


class Encoder:
    """Encodes words, which are strings of base symbols, by the automaton."""

    def __init__(self, tables: dict):
        self.labels, suffix = tables["labels"], tables["suffix"]
        self.arcs = Arcs(tables)
        live = {label: i for i, label in enumerate(self.labels[: tables["size"]]) if label is not None and tables["live"][i]}
        self.inner = {label: i for label, i in live.items() if not suffix or not label.endswith(suffix)}
        self.last = {label[: -len(suffix)]: i for label, i in live.items() if label.endswith(suffix)} if suffix else self.inner
        self.inner_lengths, self.last_lengths = _lengths(self.inner), _lengths(self.last)

    def encode(self, word: str) -> list[int]:
        """The only path that reads ``word``. Each of its beginnings has one path too, whose last token and its start are kept."""
        whole = self.last.get(word)
        if whole is not None:
            return [whole]
        n, known, size, leads = len(word), self.arcs.known, self.arcs.size, self.arcs.leads
        tokens, starts = [0] * (n + 1), [0] * (n + 1)
        ids, lengths = self.inner, self.inner_lengths
        for end in range(1, n + 1):
            if end == n:
                ids, lengths = self.last, self.last_lengths
            for length in lengths.get(word[end - 3 : end], SHORT) if end > 2 else SHORT:
                start = end - length
                if start >= 0 and (token := ids.get(word[start:end])) is not None:
                    if not start:
                        break
                    good = known.get(tokens[start] * size + token)
                    if good is None:
                        good = leads(tokens[start], token)
                    if good:
                        break
            else:
                raise ValueError("a word has symbols that the vocabulary lacks")
            tokens[end], starts[end] = token, start
        path, end = [], n
        while end:
            path.append(tokens[end])
            end = starts[end]
        path.reverse()
        return path


def _lengths(ids: dict[str, int]) -> dict[str, tuple[int, ...]]:
    """Lengths of the labels that end with these three symbols, long ones first, and of shorter labels."""
    found: dict[str, set[int]] = {}
    for label in ids:
        if len(label) > 2:
            found.setdefault(label[-3:], set()).add(len(label))
    return {tail: (*sorted(lengths, reverse=True), *SHORT) for tail, lengths in found.items()}


class WordCoder(dict):
    """Words, as byte symbols, to their ids in decimal, joined by spaces; ``labels`` has the labels of the same arcs.

    A text is cut into chunks at white space, since neither normalisation nor the cut into words
    looks across it, and the library cuts each chunk. Texts of Latin letters alone, and whose words
    are cut by ``LATIN_SPLIT``, need no library for that. Both caches are bounded.
    """

    def __init__(self, tokenizer, tables: dict, config: dict):
        super().__init__()
        self.normalise, self.split = tokenizer.normalizer, tokenizer.pre_tokenizer
        self.encoder, self.names, self.labels, self.cut = Encoder(tables), tables["labels"], {}, {}
        self.numbers = list(map(str, range(len(self.names))))
        self.added = {t["content"]: t["id"] for t in config.get("added_tokens", [])}
        self.between = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.latin = config["normalizer"] == LATIN_NORMALIZER and config["pre_tokenizer"]["pretokenizers"] == LATIN_PRETOKENIZER
        self.symbols = {b: s for s, b in byte_symbols().items()}

    def __missing__(self, word: str) -> str:
        ids = [self.added[word[1:]]] if word[0] == ADDED else self.encoder.encode(word)
        numbers, names = self.numbers, self.names
        self[word] = found = " ".join([numbers[i] for i in ids])
        self.labels[word] = " ".join([names[i] for i in ids])
        return found

    def bound(self) -> None:
        if len(self) > CACHE_WORDS:
            self.clear()
            self.labels.clear()
        if len(self.cut) > CACHE_CHUNKS:
            self.cut.clear()

    def words(self, text: str) -> list[str]:
        if self.latin and not BEYOND_LATIN(text) and not (self.between and self.between.search(text)):
            found = LATIN_SPLIT(text.lower())
            return found if text.isascii() else [w if w.isascii() else w.encode().decode("latin-1").translate(self.symbols) for w in found]
        out: list[str] = []
        for chunk in CHUNKS(text):
            found = self.cut.get(chunk)
            if found is None:
                found = []
                for part in self.between.split(chunk) if self.between else [chunk]:
                    if part in self.added:
                        found.append(ADDED + part)
                    elif part:
                        found += [w for w, _ in self.split.pre_tokenize_str(self.normalise.normalize_str(part))]
                if len(chunk) <= CHUNK_CHARS:
                    self.cut[chunk] = found
            out += found
        return out


def _check(config: dict) -> None:
    """Only what the chunks rely on is taken: splits that drop white space, added tokens that are found as they are."""
    splits = [p for p in (config.get("pre_tokenizer") or {}).get("pretokenizers", []) if p["type"] == "Split" and p["invert"] and p["behavior"] == "Removed"]
    if not splits or config.get("decoder") or config.get("normalizer") is None:
        raise ValueError("a normaliser, a split that drops white space, and no decoder are needed")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in config.get("added_tokens", [])):
        raise ValueError("added tokens that match more than their own string aren't supported")


def encode_documents(df: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_tokens, ids, decoded)``: a text's ids in decimal, joined by spaces, and the labels of their arcs, joined by spaces.

    These are the ids that the tokenizers library gives without adding special tokens, and its
    decoding of them; one text in each slice of 256 is compared with it, and a difference ends the
    job. One row per input row, repeated ones too. A null or empty text, or one of white space, has
    no tokens and decodes to the empty text; texts and words of any length are encoded whole, in
    time that grows with their length. Strings of special tokens inside texts are those tokens.
    Other columns of ``df`` aren't read; an empty table gives an empty result.
    """
    config = json.loads(tokenizer_json)
    _check(config)
    shared = df.sparkSession.sparkContext.broadcast((tokenizer_json, compile_merges(config)))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        text_json, tables = shared.value
        tokenizer = Tokenizer.from_str(text_json)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        coder = WordCoder(tokenizer, tables, json.loads(text_json))
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                texts = [t or "" for t in part.column(1).to_pylist()]
                coder.bound()
                words = [coder.words(t) for t in texts]
                ids = [" ".join(map(coder.__getitem__, w)) for w in words]
                decoded = [" ".join(map(coder.labels.__getitem__, w)) for w in words]
                counts = [x.count(" ") + 1 if x else 0 for x in ids]
                sample = min(range(len(texts)), key=lambda i: (not texts[i], len(texts[i])))
                theirs = tokenizer.encode(texts[sample], add_special_tokens=False).ids
                if ids[sample] != " ".join(map(str, theirs)) or decoded[sample] != tokenizer.decode(theirs, skip_special_tokens=False):
                    raise ValueError("a text's ids or their decoding differ from the library's")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=[id_col, "n_tokens", "ids", "decoded"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(encoded, f"`{id_col}` long, n_tokens long, ids string, decoded string")
