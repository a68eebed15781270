r"""Information-theoretic sanitisation of personal data, with DataFrame functions only.

Patterns find the protected entities of each text. Terms in the words around an entity's mentions
may still give it away: over the whole corpus, the share of a term's occurrences that lie around
mentions of entity e estimates p(e|t), and the share of all words that do estimates p(e). The
pointwise mutual information of term and entity as a share of the entity's information content,
``log2(p(e|t) / p(e)) / -log2(p(e))``, is 1 where the term always comes with the entity and 0 where
it says nothing. Terms over the upper threshold are removed, those over the lower one generalised,
wherever they stand in the documents that mention the entity.

Java's regular expressions have no offsets in Spark, so a match's place is summed up from the parts
that ``split`` leaves between the matches. Where the plain pattern would look at a run of
characters again from each of its places, the ones here begin only at a run's first place or at the
end of the last match (``\G``), and match without going back: the matches are the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigrain.llm.staging import sieved, staged

KINDS = ("email", "ip", "card", "phone")
WINDOW = 48
STRETCH = 4096
GROUP = 256
MIN_DOCS = 2
REMOVE_AT = 0.9
GENERALISE_AT = 0.7
TERM = r"[\p{L}][\p{L}\p{N}_'-]{2,}+"
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of this has no valid entity of the kind, and its matches aren't looked for.
LIKELY = {"email": r"@[A-Za-z0-9-]++\.[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
#: A number of at most 255 with any leading zeros; zero is zeros alone.
PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9][0-9]?)?"
SPANS = "array<struct<start:int,end:int,value:string>>"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` bound to a variable, so that it is worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches in order, with their code points' ends."""

    def pairs(text: Column) -> Column:
        between = F.split(text, pattern, -1)
        return once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda v, b: F.struct(v.alias("value"), b.alias("before"))))

    return once(once(text, pairs), _placed)


def _placed(pairs: Column) -> Column:
    """Spans of values from what stands before each: sums within groups of GROUP, and over the groups' sums."""
    nothing = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {SPANS})").alias("spans"))

    def step(done: Column, next_: Column) -> Column:
        start = done["at"] + F.length(next_["before"])
        end = start + F.length(next_["value"])
        span = F.struct(start.alias("start"), end.alias("end"), next_["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(done["spans"], F.array(span)).alias("spans"))

    def joined(groups: Column) -> Column:
        begins = F.aggregate(groups, F.array(F.lit(0)), lambda done, g: F.concat(done, F.array(F.element_at(done, -1) + g["at"])))
        moved = F.zip_with(groups, F.slice(begins, F.lit(1), F.size(groups)), lambda g, by: F.transform(g["spans"], lambda x: F.struct((x["start"] + by).alias("start"), (x["end"] + by).alias("end"), x["value"].alias("value"))))
        return F.flatten(moved)

    groups = F.transform(F.sequence(F.lit(0), F.greatest(F.size(pairs) - 1, F.lit(0)), F.lit(GROUP)), lambda i: F.aggregate(F.slice(pairs, i + 1, F.lit(GROUP)), nothing, step))
    return once(groups, joined)


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def entity_spans(kind: str, text: Column) -> Column:
    """The valid entities of a kind in ``text``: matches that fail are dropped."""
    found = F.filter(matches(text, PATTERNS[kind]), lambda x: _valid(kind, x["value"]))
    return F.when(text.rlike(LIKELY[kind]), found).otherwise(F.expr(f"cast(array() as {SPANS})"))


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def masked(text: Column) -> Column:
    """``text`` with a line feed for each character of an entity, so that no term lies across one."""
    def hide(kind: str) -> Callable[[Column], Column]:
        def hidden(text: Column) -> Column:
            found, between = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), F.split(text, PATTERNS[kind], -1)
            put = F.transform(found, lambda v: F.when(_valid(kind, v), F.repeat(F.lit("\n"), F.length(v))).otherwise(v))
            both = F.flatten(F.zip_with(between, put, lambda b, h: F.array(b, F.coalesce(h, F.lit("")))))
            return F.when(text.rlike(LIKELY[kind]), F.array_join(both, "")).otherwise(text)

        return hidden

    for kind in KINDS:
        text = once(text, hide(kind))
    return text


def _stretches(text: Column) -> Column:
    """``text`` in pieces of STRETCH code points, so that a window is cut without a walk through the whole of it."""
    return F.transform(F.sequence(F.lit(0), F.length(text), F.lit(STRETCH)), lambda i: F.substring(text, i + 1, F.lit(STRETCH)))


def _around(stretches: Column, start: Column, end: Column) -> Column:
    """Terms with their places, wholly within WINDOW code points before or after an entity."""

    def window(begin: Column, size: Column) -> Column:
        at = F.floor(begin / STRETCH).cast("int")
        both = F.concat(F.get(stretches, at), F.coalesce(F.get(stretches, at + 1), F.lit("")))
        return F.substring(both, begin - at * STRETCH + 1, size)

    first = F.greatest(start - WINDOW - 1, F.lit(0))
    left, right = window(first, start - first), window(end, F.lit(WINDOW + 1))
    before = F.filter(matches(left, TERM), lambda x: (x["start"] > 0) | (first == 0))
    after = F.filter(matches(right, TERM), lambda x: (x["end"] <= WINDOW) | (F.length(right) <= WINDOW))
    moved = lambda found, by: F.transform(found, lambda x: F.struct((x["start"] + by).alias("start"), (x["end"] + by).alias("end"), F.lower(x["value"]).alias("value")))
    return F.concat(moved(before, first), moved(after, end))


def _named(kind: str) -> Column:
    return F.transform(F.col(kind), lambda x: F.struct(F.concat(F.lit(f"{kind}:"), F.lower(x["value"])).alias("entity"), x["start"].alias("start"), x["end"].alias("end")))


def _masked(kind: str) -> Column:
    return F.transform(F.col(kind), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(f"[{kind.upper()}]").alias("put")))


def _label(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["start"], x["end"]))


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window_docs: int = MIN_DOCS, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT) -> DataFrame:
    """``(id_col, key, email, ip, card, phone, term)``: the spans of each kind, a row for each row of ``df``.

    ``term`` has every place of the terms that disclose an entity of the document, each with its
    ``action`` (``generalise`` or ``remove``); a term counts only if it stands near the entity in at
    least ``window_docs`` documents. Terms never overlap an entity. A null text counts as empty;
    repeated rows, null ids among them, are one document in the counts and get the same spans; texts
    are searched whole, with any number of entities; other columns aren't read; an empty table gives
    an empty result. ``key`` tells rows apart by id and text.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("id", "text"))
    found = rows.withColumns({k: entity_spans(k, F.col("text")) for k in KINDS})
    found = found.withColumn("entities", F.concat(*map(_named, KINDS)))
    near = once(once(masked(F.col("text")), _stretches), lambda pieces: F.transform("entities", lambda e: F.struct(e["entity"].alias("entity"), _around(pieces, e["start"], e["end"]).alias("terms"))))
    base = staged(found.select("id", "key", *KINDS, F.when(F.size("entities") > 0, near).alias("near")), "entities")

    mentions = base.where("near is not null").select("key", F.explode("near").alias("near")).select("key", "near.entity", F.explode("near.terms").alias("t"))
    mentions = mentions.select("key", "entity", F.col("t.value").alias("term"), F.col("t.start").alias("start")).distinct()
    by_text = staged(mentions.groupBy("term", "entity", "key").agg(F.count(F.lit(1)).alias("n")), "mentions")
    together = by_text.groupBy("term", "entity").agg(F.sum("n").alias("n_te"), F.count(F.lit(1)).alias("docs"))
    around = by_text.groupBy("entity").agg(F.sum("n").alias("n_e"))
    counts = rows.select(F.explode(terms(masked(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    counts = staged(counts, "terms")
    every = counts.agg(F.sum("n_t")).first()[0] or 1
    score = disclosure(F.col("n_te"), F.col("n_t"), F.col("n_e"), every)
    action = F.when(score >= remove_at, "remove").when(score >= generalise_at, "generalise")
    pairs = together.where(F.col("docs") >= window_docs).join(counts, "term").join(around, "entity").withColumn("action", action).where("action is not null")
    hits = staged(by_text.join(pairs.select("term", "entity", "action"), ["term", "entity"]).groupBy("key", "term").agg(F.max("action").alias("action")), "hits")

    texts = sieved(rows, "key", hits.select("key")).join(hits.select("key").distinct(), "key").dropDuplicates(["key"])
    every_term = texts.select("key", F.explode(matches(masked(F.col("text")), TERM)).alias("t")).select("key", F.lower("t.value").alias("term"), "t.start", "t.end")
    spans = every_term.join(hits, ["key", "term"]).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "action"))).alias("term"))
    return base.select("id", "key", *KINDS).join(spans, "key", "left").select(F.col("id").alias(id_col), "key", *KINDS, F.coalesce("term", F.expr("cast(array() as array<struct<start:int,end:int,action:string>>)")).alias("term"))


def disclosure(n_te: Column, n_t: Column, n_e: Column, every: int) -> Column:
    """Pointwise mutual information of a term and an entity over the entity's information content, from counts."""
    p_e = n_e / F.lit(float(every + 1))
    return F.log2(F.least(F.lit(1.0), n_te / n_t) / p_e) / -F.log2(p_e)


def span_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the entities, a digest of their spans, and all spans as ``kind:start:end``."""
    base = F.concat(*(_label(k, F.col(k)) for k in KINDS))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(id_col, *counts, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, _label("term", F.col("term"))), ",").alias("spans"))


def sanitised_texts(df: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with entities and generalised terms replaced by their kind and removed terms left out."""
    marks = F.concat(*map(_masked, KINDS), F.transform("term", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.when(x["action"] == "remove", "").otherwise("[TERM]").alias("put"))))
    by_key = found.dropDuplicates(["key"]).select("key", F.array_sort(marks).alias("_marks"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    free = F.aggregate("_marks", F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,put:string>>)").alias("marks")), lambda d, m: F.when(m["start"] < d["at"], d).otherwise(F.struct(m["end"].alias("at"), F.concat(d["marks"], F.array(m)).alias("marks"))))["marks"]
    upto = lambda i: F.when(i == 0, 0).otherwise(F.get("_free", i - 1)["end"])
    parts = F.transform("_free", lambda m, i: F.concat(F.substring(text, upto(i) + 1, m["start"] - upto(i)), m["put"]))
    rest = F.substring(text, F.element_at("_free", -1)["end"] + 1, F.length(text))
    joined = df.withColumn("_key", F.xxhash64(F.col(id_col), text)).join(by_key.withColumnRenamed("key", "_key"), "_key").withColumn("_free", free)
    return joined.withColumn(text_col, F.when(F.size("_marks") > 0, F.concat(F.array_join(parts, ""), rest)).otherwise(F.col(text_col))).select(*df.columns)
