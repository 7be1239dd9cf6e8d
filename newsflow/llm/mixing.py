"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells by their source, language and topic; the tokens of
a cell are its first weight. Raking multiplies the weights of all cells with
one source by what brings their sum to that source's target, then does the
same for languages and for topics, and repeats until no margin is further
than ``tolerance`` from its target (targets that contradict each other, for
lack of cells, end at ``max_sweeps``). A fitted weight times the token budget
is what a cell should give; divided by the cell's tokens it is the sampling
probability of its documents. Probabilities end at 1, and what such a cell
cannot give is spread over the others in proportion to their weights, so the
expected number of sampled tokens meets the budget whenever the cells with a
positive weight hold that many. A document is taken when a hash of its id
and text, read as a number in [0, 1), lies below its cell's probability:
the same on every run, alike for repeated rows.

Everything larger than a few numbers stays in Spark: a sweep is three window
sums over the table of cells, written to the shared checkpoint folder every
``SWEEPS`` sweeps; the driver reads one error and the calibration sums.

Targets default to tempered shares: tokens ** ``temper`` of each value, so
large sources shrink and small ones grow. Explicit targets are tables
(value, weight); a value without one has target zero.

Defined results: NULL is a value of its own in every dimension; a NULL or
blank text counts 0 tokens, and a cell without tokens gets probability 0 (an
explicit positive target does not change that); an empty table gives an
empty result; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import fresh

SWEEPS = 3                  # between two written tables
BROADCAST_CELLS = 100_000   # cells up to which their table is broadcast (under 10 MB)


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"\S+")), F.lit(0)).cast("long")


def _with_target(cells: DataFrame, dim: str, number: int, targets: DataFrame | None, temper: float) -> DataFrame:
    """Adds the target share t<number> of a cell's value in one dimension."""
    if targets is None:
        per_value = cells.groupBy(dim).agg(F.sum("tokens").alias("_n")) \
            .select(F.col(dim).alias("_value"), F.when(F.col("_n") > 0, F.pow("_n", F.lit(temper))).otherwise(0.0).alias("_w"))
    else:
        per_value = targets.select(F.col("value").alias("_value"), F.col("weight").cast("double").alias("_w"))
        present = cells.groupBy(dim).agg(F.sum("tokens").alias("_n")).where("_n > 0")
        per_value = per_value.join(present, F.col("_value").eqNullSafe(F.col(dim)), "left_semi")
    total = per_value.agg(F.sum("_w").alias("_total"))
    return (cells.join(per_value, cells[dim].eqNullSafe(F.col("_value")), "left").crossJoin(F.broadcast(total))
            .withColumn(f"t{number}", F.coalesce(F.col("_w") / F.nullif("_total", F.lit(0.0)), F.lit(0.0)))
            .drop("_value", "_w", "_total"))


def rake(cells: DataFrame, dims: list[str], targets: dict[str, DataFrame] | None = None, temper: float = 0.7,
         tolerance: float = 1e-6, max_sweeps: int = 60) -> DataFrame:
    """Adds ``weight`` to cells (dims, tokens): the fitted share of the mix."""
    for number, dim in enumerate(dims):
        cells = _with_target(cells, dim, number, (targets or {}).get(dim), temper)
    now = materialize(cells.withColumn("weight", F.col("tokens").cast("double")), "rake")

    def share(number: int, dim: str) -> Column:
        return F.sum("weight").over(Window.partitionBy(dim))

    for _ in range(0, max_sweeps, SWEEPS):
        for _ in range(SWEEPS):
            for number, dim in enumerate(dims):
                now = now.withColumn("weight", F.coalesce(
                    F.col("weight") * F.col(f"t{number}") / F.nullif(share(number, dim), F.lit(0.0)), F.lit(0.0)))
        now = materialize(now, "rake")
        off = F.lit(0.0)
        for number, dim in enumerate(dims):
            off = F.greatest(off, F.abs(share(number, dim) - F.col(f"t{number}")))
        worst = now.select(off.alias("off")).agg(F.max("off")).first()[0]
        if worst is None or worst <= tolerance:
            break
    return now


def calibrate(cells: DataFrame, budget: float) -> DataFrame:
    """Adds ``probability`` to raked cells: least(1, s * weight / tokens) with
    the s for which the expected tokens are the budget. Each round caps the
    cells that exceed 1 and spreads the rest; the capped set only grows."""
    ratio = F.col("weight") / F.nullif(F.col("tokens"), F.lit(0))
    s, capped = budget, -1
    while True:
        full = F.coalesce(ratio * s >= 1, F.lit(False))
        r = cells.agg(F.sum(full.cast("long")), F.sum(F.when(full, F.col("tokens"))),
                      F.sum(F.when(~full, F.col("weight")))).first()
        if r[0] is None or r[0] == capped or not r[2]:
            break
        capped = r[0]
        s = max(s, (budget - (r[1] or 0)) / r[2])
    # least() skips NULL: a cell without tokens has no ratio
    return cells.withColumn("probability", F.when(ratio.isNotNull(), F.least(F.lit(1.0), ratio * s)).otherwise(0.0))


def mix(docs: DataFrame, dims: list[str], budget_share: float, id_col: str = "doc_id", text_col: str = "text",
        targets: dict[str, DataFrame] | None = None, temper: float = 0.7, seed: int = 23,
        out: tuple[str, str, str] = ("n_tokens", "probability", "taken")) -> DataFrame:
    """Adds n_tokens, probability and taken to every document. The budget is
    a share of all tokens."""
    tokens, probability, taken = out
    keyed = docs.withColumn(tokens, word_count(text_col))
    keys = fresh(keyed, *[f"d{i}" for i in range(len(dims))])
    cells = materialize(keyed.groupBy(*[F.col(d).alias(k) for d, k in zip(dims, keys)])
                        .agg(F.sum(tokens).alias("tokens")), "cells")
    size = cells.agg(F.count(F.lit(1)), F.sum("tokens")).first()
    renamed = {k: (targets or {}).get(d) for d, k in zip(dims, keys)}
    fitted = calibrate(rake(cells, keys, renamed, temper), budget_share * (size[1] or 0))
    fitted = materialize(fitted.select(*keys, F.col("probability").alias(probability)), "mix")
    on = None
    for d, k in zip(dims, keys):
        same = keyed[d].eqNullSafe(fitted[k])
        on = same if on is None else on & same
    joined = keyed.join(F.broadcast(fitted) if size[0] <= BROADCAST_CELLS else fitted, on, "left").drop(*keys)
    unit = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed)), 11) / F.lit(float(1 << 53))
    return joined.withColumn(taken, unit < F.col(probability))


def sample(docs: DataFrame, dims: list[str], budget_share: float, **options) -> DataFrame:
    """The rows of ``docs`` that ``mix`` takes."""
    out = tuple(fresh(docs, "n_tokens", "probability", "taken"))
    return mix(docs, dims, budget_share, out=out, **options).where(F.col(out[2])).drop(*out)
