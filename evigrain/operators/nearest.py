"""The rows of a table with the highest dot products to some of its rows, by products of whole blocks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigrain.functions import text as T
from evigrain.operators import relational

#: Components of the rows and of the asked rows in a block, and the asked rows that are scored at a time.
BLOCK, ASKED_BLOCK, ROWS = 1 << 20, 1 << 19, 256


def _rounded(score: np.ndarray, digits: int) -> np.ndarray:
    """Rounded half up as decimals are printed; only values close to a half need their decimals."""
    scaled = np.abs(score) * 10.0**digits
    found = np.copysign(np.floor(scaled + 0.5) / 10.0**digits, score)
    close = (np.abs(scaled - np.floor(scaled) - 0.5) < 1e-3) | (scaled > 1e12)
    values, place = np.unique(score[close], return_inverse=True)
    step = Decimal(1).scaleb(-digits)
    found[close] = np.array([float(Decimal(repr(float(v))).quantize(step, ROUND_HALF_UP)) if abs(v) < 1e15 else v for v in values], np.float64)[place]
    return found + 0.0


def _best(k: int, digits: int) -> Callable:
    """The ``k`` best rows of a block for each asked row of a block, by rounded score, then by id."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        ids, asked = table.column("id").to_numpy(), table.column("asked").to_numpy()
        flat = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        vectors = flat.reshape(len(ids), -1)
        x, x_id, q, q_id = vectors[~asked], ids[~asked], vectors[asked], ids[asked]
        # scores of a product of blocks are added up in another order than those that count
        slack = 2 * 10.0**-digits + 1e-15 * vectors.shape[1] * np.sqrt((x * x).sum(1).max(initial=0)) * np.sqrt((q * q).sum(1))
        for i in range(0, len(q) if len(x) else 0, ROWS):
            part, part_id = q[i : i + ROWS], q_id[i : i + ROWS]
            near = part @ x.T
            near[part_id[:, None] == x_id[None, :]] = -np.inf
            last = np.partition(near, max(len(x) - k, 0), axis=1)[:, max(len(x) - k, 0)]
            at, of = np.nonzero((near >= (last - slack[i : i + ROWS])[:, None]) & (near > -np.inf))
            score = np.zeros(len(at))
            for d in range(vectors.shape[1]):
                score += part[at, d] * x[of, d]
            score = _rounded(score, digits)
            order = np.lexsort((x_id[of], -score, at))
            at, of, score = at[order], of[order], score[order]
            kept = np.arange(len(at)) - np.searchsorted(at, at) < k
            yield pa.RecordBatch.from_arrays([pa.array(part_id[at[kept]]), pa.array(x_id[of[kept]]), pa.array(score[kept])], ["query_id", "vec_id", "score"])

    return best


def top_products(rows: DataFrame, asked: str, k: int, digits: int = 6) -> DataFrame:
    """``(query_id, vec_id, score, rank)``: of all rows ``(vec_id, embedding)``, the ``k`` with the highest rounded dot product to each row that meets ``asked``, itself left out.

    Blocks of rows meet blocks of asked rows; a task keeps ``k`` rows of its block for each asked
    row. Products of blocks only name them, their scores are added up component by component.
    Vectors that are null, of another length than most, or not finite throughout meet the others
    row by row, as they have no score or none that a block could order.
    """
    whole = F.col("embedding").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf))
    rows = rows.withColumn("whole", F.coalesce(whole, F.lit(False))).withColumn("wide", F.size("embedding"))
    counts = rows.where("whole and wide > 0").groupBy("wide").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr(asked)).alias("asked")).orderBy(F.desc("n"), "wide").first() or {"wide": 1, "n": 0, "asked": 0}
    usual = F.col("whole") & (F.col("wide") == counts["wide"])
    parts, asked_parts = (max(1, math.ceil(n * counts["wide"] / size)) for n, size in ((counts["n"], BLOCK), (counts["asked"], ASKED_BLOCK)))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    vector = [F.col("vec_id").alias("id"), "embedding"]
    sides = rows.where(usual).select(block(parts).alias("of"), every(asked_parts).alias("at"), F.lit(False).alias("asked"), *vector)
    sides = sides.unionByName(rows.where(usual & F.expr(asked)).select(every(parts).alias("of"), block(asked_parts).alias("at"), F.lit(True).alias("asked"), *vector))
    dealt = sides.repartition(min(2 * parts * asked_parts, 2048), "of", "at").groupBy("of", "at")
    found = dealt.applyInArrow(_best(k, digits), "query_id long, vec_id long, score double")
    # the score of a pair with an unusual vector is null or not a number
    one, other = rows.select("vec_id", "embedding", usual.alias("x_usual")), rows.where(asked).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), usual.alias("q_usual"))
    rest = one.where("not x_usual").join(other, F.col("query_id") != F.col("vec_id")).unionByName(one.where("x_usual").join(other.where("not q_usual"), F.col("query_id") != F.col("vec_id")))
    rest = rest.select("query_id", "vec_id", F.round(T.dot(F.col("q"), F.col("embedding")), digits).alias("score"))
    return relational.top_k(found.unionByName(rest), ["query_id"], [F.desc("score"), F.asc("vec_id")], k)
