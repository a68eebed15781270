"""Registration of queries, each with its DuckDB counterpart where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evigrain.functions.tokenizer import CJK, SEARCH_STOPWORDS, SEARCH_WORD

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function of ``table``, which reads a table by name, under the function's name."""

    def register(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def tokens_sql(text: str, lang: str) -> str:
    """Search tokens of a text in DuckDB, for texts that folding doesn't change."""
    words = f"regexp_extract_all(regexp_replace(lower({text}), '[''’ʼ]', ' ', 'g'), '{SEARCH_WORD}')"
    run = f"regexp_replace(t, '[^{CJK}]', '', 'g')"
    grams = f"list_transform(range(1, greatest(length({run}) - 1, 1) + 1), lambda i: substr({run}, i, 2))"
    spread = f"flatten(list_transform({words}, lambda t: CASE WHEN NOT regexp_matches(t, '[{CJK}]') THEN [t] WHEN regexp_matches(t, '[a-z]') THEN [t] || {grams} ELSE {grams} END))"
    stop = " ".join(f"WHEN '{name}' THEN {sql_list(found)}" for name, found in SEARCH_STOPWORDS.items())
    return f"list_filter({spread}, lambda w: NOT list_contains(CASE lower({lang}) {stop} ELSE {sql_list(SEARCH_STOPWORDS['en'])} END, w))"
