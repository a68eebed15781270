"""Quality classifier: perplexity under an n-gram model of trusted text.

An interpolated modified Kneser-Ney bigram model is trained on all documents of one half of the
trusted ones. Their ids are staged as a bit set, a row for each 64 ids that follow each other, which
Spark broadcasts unless it is large, so no text is shuffled. The other half, all of it, which the
model has not seen, gives each language's threshold: a high quantile of their log perplexity, within
a rank of one in 20,000. A document over its language's threshold is rejected. The counts lie in
shards of sorted arrays, and the sorted keys of each slice of documents are joined with them shard
by shard, so neither the model nor the documents' n-grams are shuffled or held whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigrain.llm import ngrams
from evigrain.llm.staging import staged

QUANTILE = 0.998
MIN_TOKENS = 10
MIN_TRUSTED = 50


def _among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``id`` is one of ``ids``, without nulls."""
    word, bit = F.shiftright("id", 6), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("id").bitwiseAND(F.lit(63)).cast("int"))
    bits = staged(ids.groupBy(word.alias("the word")).agg(F.bit_or(bit).alias("the bits")), "learn")
    return docs.join(bits, word == F.col("the word")).where(F.col("the bits").bitwiseAND(bit) != 0)


def _judged(df: DataFrame, trusted: DataFrame, keep: list[str], id_col: str, text_col: str, lang_col: str, quantile: float) -> DataFrame:
    """The columns ``keep`` of every row, as ``column 0`` and so on, with its scores and verdict."""
    ids = trusted.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct()
    docs = df.select(*(F.col(c).alias(f"column {i}") for i, c in enumerate(keep)), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    learn = F.crc32(F.col("id").cast("string").cast("binary")) % 2 == 0
    model = ngrams.train(_among(docs, ids.where(learn)).select("text"))
    kept_columns = [F.col(f"column {i}") for i in range(len(keep))]
    found = ngrams.score(docs, model, [*kept_columns, F.col("id"), F.col("lang")], F.col("text"))
    found = staged(found.withColumn("surprise", -F.col("score") / F.col("n_tokens")).drop("n_known", "base_score", "score"), "quality")
    held_out = found.where(F.col("n_tokens") >= MIN_TOKENS).select("id", "lang", "surprise").join(ids.where(~learn), "id", "left_semi")
    high = F.percentile_approx("surprise", F.lit(quantile), F.lit(20000))
    by_lang = held_out.groupBy("lang").agg(high.alias("own"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_TRUSTED)
    limits = by_lang.select("lang", "own", F.lit(False).alias("every")).unionByName(held_out.agg(high.alias("own")).select(F.lit(None).cast("string").alias("lang"), "own", F.lit(True).alias("every")))
    limits = staged(limits.coalesce(1), "thresholds")
    every = limits.where("every").first()
    judged = found.join(limits.where("not every").select(F.col("lang").alias("of"), "own"), found["lang"].eqNullSafe(F.col("of")), "left")
    threshold = F.coalesce("own", F.lit(every and every["own"]).cast("double"))
    kept = (F.col("n_tokens") < MIN_TOKENS) | threshold.isNull() | (F.col("surprise") <= threshold)
    return judged.select(*kept_columns, "id", "lang", "n_tokens", F.pow(F.lit(10.0), "surprise").alias("perplexity"), F.pow(F.lit(10.0), threshold).alias("threshold"), kept.alias("kept"))


def quality_scores(df: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """``(id_col, lang_col, n_tokens, perplexity, threshold, kept)``, a row for each row of ``df``.

    ``trusted`` holds the ids of trusted documents, in a column named ``id_col``. Documents with
    fewer than ``MIN_TOKENS`` tokens, null and empty texts among them, can't be judged and are
    kept. A language, null included, with fewer than ``MIN_TRUSTED`` held-out trusted documents
    takes the threshold of all of them; with no trusted documents at all everything is kept.
    Repeated rows are judged alike; other columns aren't read; an empty table gives an empty result.
    """
    found = _judged(df, trusted, [], id_col, text_col, lang_col, quantile)
    return found.select(F.col("id").alias(id_col), F.col("lang").alias(lang_col), "n_tokens", "perplexity", "threshold", "kept")


def keep_good(df: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """The rows of ``df``, with all their columns, that ``quality_scores`` keeps; the columns go along, so no text is shuffled."""
    found = _judged(df, trusted, df.columns, id_col, text_col, lang_col, quantile).where("kept")
    return found.select(*(F.col(f"column {i}").alias(c) for i, c in enumerate(df.columns)))
