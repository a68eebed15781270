r"""Secret scans: patterns, and a linear-chain conditional random field for what they miss.

Tokens are runs of ASCII letters and digits, runs of other letters, and single signs. A token's
features are its shape, the shapes of its neighbours, the make-up of the unbroken stretch of key
characters it belongs to, and what kind of file it stands in; tags are begin, inside and outside,
an inside only after a begin or inside. A secret has at least ``MIN_CHARS`` key characters, or
``MIN_AFTER_KEY`` where it follows a key word and an assignment, so only pieces between white space
with such a stretch can hold one; those are decoded by Viterbi as a whole, wherever they stand.

The field learns from three kinds of labelled pieces, each bounded in number: pieces of the corpus
with a pattern's match, as they stand and once more with the pattern's cue (key word or prefix)
replaced; pieces of the corpus without a match; and generated ones in contexts from the corpus:
secrets of forms that no pattern covers, and addresses, paths, names and numbers that only look so.
It is fitted by gradient ascent of the penalised likelihood, and applied to every text.
"""

from __future__ import annotations

import math
import random
import re
import string
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
#: Bounds of the training set: pieces of each kind, characters on either side that go along, and tokens of a piece.
SAMPLE = 1500
CONTEXT = 60, 40
MAX_TRAIN_CHARS, MAX_TRAIN_TOKENS = 400, 40
ROUNDS = 150
MIN_CHARS, MIN_AFTER_KEY = 16, 8
OFFSETS = (-3, -2, -1, 0, 1)
OUTSIDE, BEGIN, INSIDE = 0, 1, 2

#: Fixed patterns; letters of the first one stand for either case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

HEX_SIGNS = bytes(120 if chr(i) in "0123456789abcdef" else 46 for i in range(256))
HEX_RUN = b"x" * 32
TOKEN = re.compile(r"[A-Za-z0-9]+|[^\W\d_A-Za-z]+|\S")
#: An unbroken stretch of key characters; equals signs only close it.
STRETCH = re.compile(r"[A-Za-z0-9+/_.-]+={0,2}")
LONG_STRETCH = re.compile(r"[A-Za-z0-9+/_.-]{16,}|[A-Za-z0-9+/_.-]{15}=|[A-Za-z0-9+/_.-]{14}==")
KEY_WORDS = ("pass", "pwd", "secret", "token", "api", "key", "auth", "cred")
#: After the word run that holds a key word: an assignment and what the value begins with.
ASSIGNED = re.compile(r"""["']?\s{0,4}[:=]\s{0,4}["']?(?:bearer\s)?(?=[A-Za-z0-9+/_.-]{8})""", re.I)
RUN = re.compile(r"\w*")
KEY_WORD = re.compile(r"pass|pwd|secret|token|api|key|auth|cred", re.I)
SPACE = re.compile(r"\s")


def _found(text: str) -> tuple[list, list, list]:
    """The valid matches of each pattern; texts that can't hold one aren't searched."""
    low = text.lower()
    assign = [m for m in ASSIGN.finditer(text) if len(m[2]) >= 8] if any(w in low for w in ASSIGN_WORDS) else []
    access = [m for m in ACCESS.finditer(text) if len(m[0]) >= 16] if "AKIA" in text else []
    return assign, access, list(HEX.finditer(text)) if HEX_RUN in text.encode().translate(HEX_SIGNS) else []


def pattern_spans(text: str) -> list[tuple[int, int, str]]:
    """The patterns' spans, by start, then kind as listed; matches that are too short are dropped."""
    found = sorted((m.start(), k, m.end()) for k, ms in enumerate(_found(text)) for m in ms)
    return [(a, b, KINDS[k]) for a, k, b in found]


def secret_spans(text: str) -> list[tuple[int, int]]:
    """What the patterns' matches hide: the value of an assignment, else the whole match."""
    assign, access, long = _found(text)
    return [m.span(2) for m in assign] + [m.span() for m in (*access, *long)]


def shape(token: str) -> tuple[int, ...]:
    """The numbers of a token's features."""
    n = len(token)
    on = [0, 1 + bisect_right((3, 7, 11, 15, 23, 31, 39), n)]
    if not token[0].isascii() or not token[0].isalnum():
        return (*on, 9 + "\"'=:/+-_.".find(token) + 1) if n == 1 else (*on, 19)
    digits, upper = sum(c.isdigit() for c in token), sum(c.isupper() for c in token)
    lower = n - digits - upper
    on += [20 + (digits > 0), 22 + (upper > 0), 24 + (lower > 0), 26 + (digits == n)]
    on.append(28 + all(c in "0123456789abcdef" for c in token))
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:], strict=False))
    on.append(30 + min(4, int(10 * turns / n)))
    counts = [token.count(c) for c in set(token)]
    on.append(35 + min(5, int(-sum(c / n * math.log2(c / n) for c in counts))))
    if KEY_WORD.search(token):
        on.append(41)
    if token.startswith("AKIA"):
        on.append(42)
    return tuple(on)


def make_up(text: str, begin: int, end: int) -> tuple[int, ...]:
    """Feature numbers of a stretch: length, kinds of characters, entropy, changes of kind, vowels, signs, and what stands around it."""
    run = text[begin:end]
    n, letters = len(run), [c for c in run if c.isalpha()]
    kinds = [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in run]
    on = [bisect_right((8, 12, 16, 20, 24, 32, 40, 64), n)]
    on.append(9 + (0 in kinds) + 2 * (1 in kinds) + 4 * (2 in kinds))
    counts = [run.count(c) for c in set(run)]
    on.append(17 + min(11, int(-2 * sum(c / n * math.log2(c / n) for c in counts))))
    turns = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    on.append(29 + min(5, int(8 * turns / n)))
    on.append(35 + min(5, int(10 * sum(c in "aeiouAEIOU" for c in letters) / len(letters))) if letters else 41)
    for k, sign in enumerate("./-_"):
        on.append(42 + 3 * k + min(2, run.count(sign)))
    longest = max(map(len, re.findall("[a-z]+", run)), default=0)
    on.append(54 + bisect_right((2, 4, 6, 9), longest))
    around = (run[-1] == "=", "@" in (text[begin - 1 : begin], text[end : end + 1]), "://" in text[max(0, begin - 8) : begin + 8], text[begin - 1 : begin] in ("\"", "'"))
    return (*on, *(59 + i for i, x in enumerate(around) if x))


SHAPES = 43
MAKE_UPS = 64
PER_TOKEN = len(OFFSETS) * (SHAPES + 1)
FEATURES = PER_TOKEN + 3 + MAKE_UPS


def file_features(text: str) -> tuple[int, ...]:
    signs = sum(text.count(c) for c in "={};")
    return tuple(PER_TOKEN + i for i, on in enumerate((signs * 50 > len(text), "BEGIN " in text or "://" in text, KEY_WORD.search(text) is not None)) if on)


def key_ends(text: str) -> set[int]:
    """Where the value begins after each key word with an assignment. A run of word characters is read once for each key word, however often it holds it."""
    low, found = text.lower(), set()

    def after(at: int) -> int:
        end = RUN.match(text, at).end()
        m = ASSIGNED.match(text, end)
        if m:
            found.add(m.end())
        return end

    if len(low) == len(text):
        for word in KEY_WORDS:
            at = low.find(word)
            while at >= 0:
                at = low.find(word, after(at))
    else:  # a few letters have longer lower forms, which move the places
        m = KEY_WORD.search(text)
        while m:
            m = KEY_WORD.search(text, after(m.start()))
    return found


def pieces(text: str) -> list[tuple[int, int, set[int]]]:
    """The pieces between white space that can hold a secret, with the places after a key word."""
    keys = key_ends(text)
    out: list[tuple[int, int, set[int]]] = []
    for start in sorted(keys | {m.start() for m in LONG_STRETCH.finditer(text)}):
        if not out or start >= out[-1][1]:
            begin = start
            while begin and not text[begin - 1].isspace():
                begin -= 1
            end = SPACE.search(text, start)
            out.append((begin, end.start() if end else len(text), set()))
        if start in keys:
            out[-1][2].add(start)
    return out


def _tokens(text: str, begin: int, end: int) -> list[tuple[int, int]]:
    return [m.span() for m in TOKEN.finditer(text, begin, end)]


def sequence(text: str, begin: int, end: int, keys: set[int], whole: tuple[int, ...], shapes: dict) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """A piece's tokens and their feature numbers."""
    own = _tokens(text, begin, end)
    before = _tokens(text, max(0, begin - CONTEXT[0]), begin)[OFFSETS[0] :]
    after = _tokens(text, end, min(len(text), end + CONTEXT[1]))[: OFFSETS[-1]]
    spans = before + own + after
    kinds = []
    for a, b in spans:
        token = text[a:b]
        if token not in shapes:
            if len(shapes) > 50_000:
                shapes.clear()
            shapes[token] = shape(token)
        kinds.append(shapes[token])
    rows, stretch, of = [], (0, 0), ()
    for i in range(len(before), len(before) + len(own)):
        on = list(whole)
        for k, offset in enumerate(OFFSETS):
            j = i + offset
            base = k * (SHAPES + 1)
            on += [base + f for f in kinds[j]] if 0 <= j < len(spans) else [base + SHAPES]
        if spans[i][0] >= stretch[1]:
            m = STRETCH.match(text, spans[i][0], end)
            stretch, of = (m.span(), make_up(text, *m.span())) if m else ((0, spans[i][1]), ())
        on += [PER_TOKEN + 3 + f for f in of]
        if spans[i][0] in keys:
            on.append(FEATURES - 1)
        rows.append(on)
    return own, rows


class Field:
    """Weights of features by tag, and of tags that follow each other."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def decode(self, rows: list[list[int]]) -> list[int]:
        """The best tags; an inside only after a begin or inside."""
        best, came = None, []
        moves = self.moves.copy()
        moves[OUTSIDE, INSIDE] = -np.inf
        for on in rows:
            own = self.weights[on].sum(axis=0)
            if best is None:
                best = own.copy()
                best[INSIDE] = -np.inf
                continue
            ways = best[:, None] + moves
            origin = ways.argmax(axis=0)
            best = ways[origin, range(3)] + own
            came.append(origin)
        tags = [int(best.argmax())]
        for origin in reversed(came):
            tags.append(int(origin[tags[-1]]))
        return tags[::-1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def fit(samples: list[tuple[list[list[int]], list[int]]], rounds: int = ROUNDS, rate: float = 0.1, penalty: float = 1e-3) -> Field:
    """Maximise the penalised likelihood of the samples' tags by full-batch Adam steps."""
    field = Field(np.zeros((FEATURES, 3)), np.zeros((3, 3)))
    if not samples:
        field.weights[:, OUTSIDE] = 1.0
        return field
    samples = sorted(samples, key=lambda x: -len(x[1]))
    n, length = len(samples), len(samples[0][1])
    active = [sum(len(x[1]) > t for x in samples) for t in range(length)]  # the first so many samples have a token t
    starts = np.cumsum([0, *active])
    on, tags = np.zeros((starts[-1], FEATURES), np.float32), np.zeros(starts[-1], int)
    for i, (rows, truth) in enumerate(samples):
        for t, (r, tag) in enumerate(zip(rows, truth, strict=True)):
            on[starts[t] + i, r], tags[starts[t] + i] = 1, tag
    at = [slice(starts[t], starts[t + 1]) for t in range(length)]
    last = np.array([len(x[1]) - 1 for x in samples])
    truth, pairs = np.eye(3)[tags], np.zeros((3, 3))
    for t in range(1, length):
        np.add.at(pairs, (tags[at[t - 1]][: active[t]], tags[at[t]]), 1)
    block = np.zeros((3, 3))
    block[OUTSIDE, INSIDE] = -1e9
    state = [np.zeros_like(field.weights), np.zeros_like(field.moves)]
    square = [np.zeros_like(field.weights), np.zeros_like(field.moves)]
    for step in range(1, rounds + 1):
        own = (on @ field.weights.astype(np.float32)).astype(float)
        own[at[0], INSIDE] = -1e9
        moves = field.moves + block
        forward, backward = np.zeros_like(own), np.zeros_like(own)
        forward[at[0]] = own[at[0]]
        for t in range(1, length):
            forward[at[t]] = _log_sum(forward[at[t - 1]][: active[t], :, None] + moves, 1) + own[at[t]]
        for t in range(length - 1, 0, -1):
            backward[at[t - 1]][: active[t]] = _log_sum(moves[None] + (own[at[t]] + backward[at[t]])[:, None, :], 2)
        total = _log_sum(forward[starts[last] + np.arange(n)], 1)
        expected, met = np.zeros_like(own), np.zeros((3, 3))
        for t in range(length):
            expected[at[t]] = np.exp(np.minimum(0, forward[at[t]] + backward[at[t]] - total[: active[t], None]))
            if t:
                p = forward[at[t - 1]][: active[t], :, None] + moves + (own[at[t]] + backward[at[t]])[:, None, :] - total[: active[t], None, None]
                met += np.exp(np.minimum(0, p)).sum(axis=0)
        slopes = [(on.T @ (truth - expected).astype(np.float32)).astype(float) / n - penalty * field.weights, (pairs - met) / n - penalty * field.moves]
        for k, (values, slope) in enumerate(zip((field.weights, field.moves), slopes, strict=True)):
            state[k] = 0.9 * state[k] + 0.1 * slope
            square[k] = 0.999 * square[k] + 0.001 * slope**2
            values += rate * (state[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    return field


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


MIXED, SAFE_SIGNS = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "-_"


def generated_secret(rng: random.Random, after_key: bool) -> str:
    """A secret of a form that needs no key word, or also of a short one after a key word."""
    some = lambda signs, low, high: "".join(rng.choices(signs, k=rng.randint(low, high)))
    forms = [
        lambda: some(MIXED + "+/", 20, 64) + "=" * rng.randint(0, 2),
        lambda: some(SAFE_SIGNS, 20, 48),
        lambda: some(string.ascii_lowercase, 2, 4) + rng.choice("_-") + some(MIXED, 20, 40),
        lambda: some(MIXED, 16, 40),
        lambda: some(string.ascii_letters, 20, 40),
        lambda: some(string.ascii_uppercase + string.digits, 16, 32),
        lambda: some("0123456789ABCDEF", 32, 64),
        lambda: some("0123456789abcdef", 20, 31),
        lambda: ".".join(some(SAFE_SIGNS, 16, 40) for _ in range(3)),
    ]
    return some(MIXED, 8, 15) if after_key and rng.random() < 0.5 else rng.choice(forms)()


def generated_other(rng: random.Random, words: list[str]) -> str:
    """What is long or mixed but no secret: addresses, paths, names, dates, numbers."""
    word = lambda: rng.choice(words)
    many = lambda sep, low, high: sep.join(word() for _ in range(rng.randint(low, high)))
    digits = lambda low, high: "".join(rng.choices(string.digits, k=rng.randint(low, high)))
    forms = [
        lambda: many("-", 2, 5),
        lambda: many("_", 2, 5),
        lambda: many("", 2, 4),
        lambda: "".join(word().title() for _ in range(rng.randint(2, 4))),
        lambda: many("_", 2, 4).upper(),
        lambda: f"https://{many('.', 2, 3)}.com/{many('/', 1, 4)}{rng.choice(['', '.html', '?id=' + digits(1, 9), '/' + digits(4, 4) + '/' + digits(2, 2)])}",
        lambda: f"/{many('/', 2, 5)}.{rng.choice(['txt', 'json', 'py', 'csv'])}",
        lambda: f"{many('.', 1, 2)}{digits(0, 4)}@{word()}.{word()}.org",
        lambda: f"{digits(4, 4)}-{digits(2, 2)}-{digits(2, 2)}T{digits(2, 2)}:{digits(2, 2)}:{digits(2, 2)}Z",
        lambda: digits(10, 20),
        lambda: "-".join(digits(3, 4) for _ in range(4)),
        lambda: f"v{digits(1, 2)}.{digits(1, 2)}.{digits(1, 3)}-{word()}.{digits(1, 2)}",
        lambda: "-".join("".join(rng.choices("0123456789abcdef", k=k)) for k in (8, 4, 4, 4, 12)),
    ]
    return rng.choice(forms)()


CUES = ("{} = ", "{}: ", "{}=", '{} = "', "{}='")
NEUTRAL, KEYS = ("value", "id", "ref", "data", "name"), ("pwd", "auth", "credential", "passphrase", "private_key", "access_key", "api-secret", "password", "token")


def generated(rng: random.Random, contexts: list[str], count: int) -> list[tuple[str, int, int, bool]]:
    """``(text, begin, end, secret)``: generated strings, half of them secrets, between words of the corpus."""
    words = sorted({w for c in contexts for w in re.findall(r"[A-Za-z]{3,}", c)}) or ["word"]
    out = []
    for i in range(count):
        secret = i % 2 == 0
        cue = rng.random() < 0.5
        value = generated_secret(rng, cue) if secret else generated_other(rng, words)
        lead = rng.choice(CUES).format(rng.choice(KEYS) if cue and (secret or rng.random() < 0.3) else rng.choice(NEUTRAL)) if cue or rng.random() < 0.2 else ""
        context = rng.choice(contexts) if contexts else ""
        cut = rng.randint(0, len(context))
        while cut < len(context) and not context[cut].isspace():
            cut += 1
        close = lead[-1:] if lead[-1:] in "\"'" else ""
        head = f"{context[:cut]} {lead}" if context[:cut] else lead
        out.append((head + value + close + rng.choice(["", "", ".", ","]) + context[cut:], len(head), len(head) + len(value), secret))
    return out


def _sample_of(text: str, secrets: list[tuple[int, int]], at: int, shapes: dict) -> tuple | None:
    """Features and tags of the piece that holds ``at``."""
    for begin, end, keys in pieces(text):
        if begin <= at < end:
            own, rows = sequence(text, begin, end, keys, file_features(text), shapes)
            if len(own) > MAX_TRAIN_TOKENS:
                return None
            tags = [OUTSIDE] * len(own)
            for a, b in secrets:
                inside = [i for i, (x, y) in enumerate(own) if a <= x and y <= b]
                for i in inside:
                    tags[i] = BEGIN if i == inside[0] else INSIDE
            return rows, tags
    return None


def _uncued(text: str, begin: int, end: int, rng: random.Random) -> tuple[str, int, int] | None:
    """The text with the cue of the secret replaced; None if what is left wouldn't be told from a word."""
    value = text[begin:end]
    if len(value) < MIN_CHARS or not any(c.isdigit() for c in value):
        return None
    if value.startswith("AKIA"):
        other = "".join(rng.choices(string.ascii_uppercase + string.digits, k=4))
        return text[:begin] + other + text[begin + 4 :], begin, end
    cues = list(re.finditer(r"(?i)(password|passwd|secret|token|api_?key)", text[:begin]))
    if not cues:
        return None
    a, b = cues[-1].span()
    other = rng.choice(NEUTRAL + KEYS[:5])
    moved = len(other) - (b - a)
    return text[:a] + other + text[b:], begin + moved, end + moved


def train(df: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Field:
    """Fit the field on at most ``sample`` pieces each of: with a match, its cue replaced, without one, generated secrets, and others."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                secrets = secret_spans(text)
                where = [(begin, end) for begin, end, _ in pieces(text) if end - begin <= MAX_TRAIN_CHARS]
                if not where and text:
                    where = [(len(text) // 2, len(text) // 2)]  # a context for generated ones
                for begin, end in where:
                    low, high = max(0, begin - CONTEXT[0]), end + CONTEXT[1]
                    inside = [(a - low, b - low) for a, b in secrets if begin <= a and b <= end]
                    part = text[low:high]
                    kind = "secret" if inside else "other" if end > begin else "context"
                    rows.append((xxhash.xxh64_intdigest(part) >> 1, kind, part, [x for ab in inside for x in ab], begin - low))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "kind", "part", "secrets", "at"])

    texts = _texts(df, text_col, text_col).select("text")
    rows = texts.mapInArrow(found, "key long, kind string, part string, secrets array<int>, at int")
    lowest = lambda kind: rows.where(F.col("kind") == kind).dropDuplicates(["key"]).orderBy("key").limit(sample)
    chosen = sorted(lowest("secret").unionByName(lowest("other")).unionByName(lowest("context")).collect(), key=lambda r: (r["key"], r["kind"]))
    rng, shapes, samples = random.Random(0), {}, []
    for r in chosen:
        spans = list(zip(r["secrets"][::2], r["secrets"][1::2], strict=True))
        if r["kind"] != "context":
            samples.append(_sample_of(r["part"], spans, spans[0][0] if spans else r["at"], shapes))
        for a, b in spans:
            other = _uncued(r["part"], a, b, rng)
            if other:
                samples.append(_sample_of(other[0], [other[1:]], other[1], shapes))
    if chosen:
        contexts = [r["part"] for r in chosen if r["kind"] != "secret"]
        samples += [_sample_of(text, [(a, b)] if secret else [], a, shapes) for text, a, b, secret in generated(rng, contexts, 2 * sample)]
    return fit([x for x in samples if x])


def field_spans(text: str, field: Field, known: list[tuple[int, int, str]], shapes: dict) -> list[tuple[int, int, str]]:
    """Secrets that the field finds besides ``known``: of ``MIN_CHARS`` characters, or ``MIN_AFTER_KEY`` after a key word."""
    where, out = pieces(text), []
    if not where:
        return out
    whole = file_features(text)
    for begin, end, keys in where:
        own, rows = sequence(text, begin, end, keys, whole, shapes)
        tags = field.decode(rows)
        i = 0
        while i < len(tags):
            if tags[i] == BEGIN:
                j = i + 1
                while j < len(tags) and tags[j] == INSIDE:
                    j += 1
                a, b = own[i][0], own[j - 1][1]
                if b - a >= (MIN_AFTER_KEY if a in keys else MIN_CHARS) and not any(x < b and a < y for x, y, _ in known):
                    out.append((a, b, "crf"))
                i = j
            else:
                i += 1
    return out


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """``(id_col, found)``: each text's secrets as an array of ``(start, end, kind)``, a row for each row of ``df``.

    Kinds are the three patterns' and ``crf``; places are code points, the end exclusive; the
    order is by start, then kind. A null text counts as empty, repeated rows are repeated, texts of
    any length are searched whole, other columns aren't read, an empty table gives an empty result.
    """
    field = field or train(df, text_col)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes: dict = {}
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                spans = pattern_spans(text)
                spans += field_spans(text, field, spans, shapes)
                spans.sort(key=lambda x: (x[0], (*KINDS, "crf").index(x[2])))
                rows.append([{"start": a, "end": b, "kind": k} for a, b, k in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=[id_col, "found"])

    texts = _texts(df, id_col, text_col)
    return texts.mapInArrow(found, f"`{id_col}` {texts.schema['id'].dataType.simpleString()}, found array<struct<start:int,end:int,kind:string>>")


def span_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the patterns' matches, a digest of their spans, and all spans as ``kind:start:end``."""
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("found", lambda x: x["kind"] != "crf")
    return found.select(id_col, *(_count(k) for k in KINDS), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))


def _count(kind: str) -> Column:
    return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


def redacted_texts(df: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """``df`` with every secret in its texts replaced by ``[SECRET]``."""
    schema, at = df.schema, df.columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes: dict = {}
        for batch in batches:
            texts = []
            for text in batch.column(at).to_pylist():
                spans = pattern_spans(text or "")
                spans = sorted(spans + field_spans(text or "", field, spans, shapes))
                done, out = 0, []
                for a, b, _ in spans:
                    if a >= done:
                        out += [text[done:a], "[SECRET]"]
                    done = max(done, b)
                texts.append("".join([*out, text[done:]]) if spans else text)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(cut, schema)
