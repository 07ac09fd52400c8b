"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic); a cell's weight is its tokens. Raking
scales the cells, margin by margin, until the weights of each source, language and topic
have their targets. A document is then sampled with the calibrated probability of its cell:
its share of the budget over its share of the tokens.

No probability exceeds 1, so a cell weighs at most its tokens over the budget, its cap.
Raking counts a full cell with its cap and goes on raising the others, so the sample itself
meets the targets. A value whose whole tokens are less than its target takes them all, and
the rest of its target goes to the margin's other values in proportion. ``shares`` reports
target and share of each value. ``clip`` cuts probabilities off after a raking without caps
instead; the sample then misses the targets.

Only cells are raked, and they are summed up before their first shuffle; their number is that
of the (source, language, topic) that occur and does not grow with the documents. One half-step
is a window per margin value over the cells, which finds the factor that meets the target with
caps, so a round is a linear plan; rounds are written to the shared folder every few rounds, and
end when no margin is off by more than ``CAPPED_TOLERANCE``, or after ``CAPPED_ROUNDS``.
Draws are MD5 hashes of the doc_id, so reruns and lost tasks agree.

*Targets* default to a flattened mix: each margin value's token share to the power
``FLATTEN``, scaled to one. A table of (value, share) replaces a margin's default; values it
does not name get nothing.

*Topics*: unless a topic expression is given, the shape of a text stands for it:
"table" (many bars), "markup" (many symbols), "loud" (mostly capitals), "prose" and "short".

Cases: null text has no tokens and null source or language is the value "none"; a cell
without tokens has probability 0 unless all of its documents are empty, and these follow
their cell as well. Repeated rows share a draw. An empty table gives an empty result.
Columns of the input named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, without

MARGINS = ("source", "lang", "topic")
FLATTEN = 0.7
BUDGET = 0.6
ROUNDS = 24
EVERY = 6
TOLERANCE = 1e-12
CAPPED_ROUNDS = 36
CAPPED_EVERY = 3
CAPPED_TOLERANCE = 1e-7
MOST = 1e200
DRAW_DIGITS = 13
OWN = ("mix_source", "mix_lang", "mix_topic", "n_tokens")


def tokens_of(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("bigint")


def share_of(text: Column, symbols: str) -> Column:
    """Share of a text's characters that a regular expression for one character matches."""
    return F.regexp_count(text, F.lit(symbols)) / F.greatest(F.length(text), F.lit(1))


def shape_topic(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return (
        F.when(share_of(text, "[|]") >= 0.02, "table")
        .when(share_of(text, r"[%$#*&<>{}\[\]=]") >= 0.05, "markup")
        .when(share_of(text, "[A-Z]") >= 0.3, "loud")
        .when(F.length(text) >= 1000, "prose")
        .otherwise("short")
    )


def celled(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """``docs`` with mix_source, mix_lang, mix_topic and n_tokens."""
    docs = without(docs, *OWN)
    return docs.withColumns({
        "mix_source": F.coalesce(F.col("source").cast("string"), F.lit("none")),
        "mix_lang": F.coalesce(F.col("lang").cast("string"), F.lit("none")),
        "mix_topic": F.coalesce(topic if topic is not None else shape_topic(F.col("text")), F.lit("none")),
        "n_tokens": tokens_of(F.col("text")),
    })


def flat_targets(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """(value, share): token shares to a power, scaled to one."""
    sums = cells.groupBy(F.col(margin).alias("value")).agg(F.sum("tokens").alias("t")).filter("t > 0")
    raised = sums.select("value", F.pow(F.col("t").cast("double"), F.lit(power)).alias("p"))
    return raised.select("value", (F.col("p") / F.sum("p").over(Window.partitionBy(F.lit(0)))).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """Cells (source, lang, topic, docs, tokens) with ``weight``, which sums to one.

    Shares of values that hold no tokens are spread over the others by scaling. Ends
    after ``rounds`` rounds if the targets contradict each other.
    """
    for m in MARGINS:
        cells = cells.join(targets[m].select(F.col("value").alias(m), F.col("share").alias(f"to_{m}")), m, "left")
        cells = cells.fillna({f"to_{m}": 0.0})
    cells = cut(cells.withColumn("weight", F.col("tokens").cast("double")), "cells")
    for at in range(0, rounds, EVERY):
        for _ in range(min(EVERY, rounds - at)):
            for m in MARGINS:
                cells = cells.withColumn("weight", half_step(m))
        cells = cut(cells, "raked")
        if (worst_margin(cells) or 0.0) <= TOLERANCE:
            break
    return cells


def within_caps(cells: DataFrame, targets: dict[str, DataFrame], m: str) -> DataFrame:
    """(value, share, wanted): the margin's targets with what no value can hold given to the others.

    The share is the smaller of a value's cap and its target times one factor for all. By
    falling need of their tokens, the factor is that of the last value that gets all of them.
    """
    held = cells.groupBy(F.col(m).alias("value")).agg(F.sum("cap").alias("cap")).join(targets[m].withColumnRenamed("share", "wanted"), "value", "left")
    held = held.fillna({"wanted": 0.0})
    order = Window.partitionBy(F.lit(0)).orderBy(F.when(F.col("wanted") > 0, F.col("cap") / F.col("wanted")).otherwise(F.lit(float("inf"))), "value")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("wanted").over(order.rowsBetween(0, Window.unboundedFollowing))
    held = held.withColumn("factor", F.when(rest > 0, (1.0 - before) / rest).otherwise(0.0))
    factor = F.max("factor").over(Window.partitionBy(F.lit(0)))
    return held.select("value", F.least("cap", factor * F.col("wanted")).alias("share"), "wanted")


def rake_capped(cells: DataFrame, targets: dict[str, DataFrame], budget: float, rounds: int = CAPPED_ROUNDS) -> DataFrame:
    """Cells with ``cap``, ``weight`` (at most the cap) and to_... and want_... of each margin."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    cells = cells.withColumn("cap", F.col("tokens").cast("double") / F.lit(float(max(total * budget, 1e-300))))
    own = {m: cut(within_caps(cells, targets, m), "targets") for m in MARGINS}
    for m in MARGINS:
        cells = cells.join(own[m].select(F.col("value").alias(m), F.col("share").alias(f"to_{m}"), F.col("wanted").alias(f"want_{m}")), m)
    cells = cut(cells.withColumn("raw", F.col("cap") * budget).withColumn("weight", F.least("raw", "cap")), "cells")
    for at in range(0, rounds, CAPPED_EVERY):
        for _ in range(min(CAPPED_EVERY, rounds - at)):
            for m in MARGINS:
                cells = capped_step(cells, m)
        cells = cut(cells.withColumn("weight", F.least("raw", "cap")), "raked")
        if (worst_margin(cells) or 0.0) <= CAPPED_TOLERANCE:
            break
    return cells


def capped_step(cells: DataFrame, m: str) -> DataFrame:
    """``raw`` times the factor with which the capped weights of each value of a margin meet its target.

    If the cells are ordered by how soon they are full, a factor that fills those before a
    cell leaves the target less their caps to the others; the largest such factor is right.
    """
    need = F.when(F.col("raw") > 0, F.col("cap") / F.col("raw")).otherwise(F.lit(float("inf")))
    rising = Window.partitionBy(m).orderBy(need, *MARGINS)
    # The other way round, as a running sum is linear and a frame to the end of a partition is not.
    falling = Window.partitionBy(m).orderBy(need.desc(), *[F.desc(o) for o in MARGINS])
    before = F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("raw").over(falling.rowsBetween(Window.unboundedPreceding, 0))
    cells = cells.withColumns({"_before": before, "_rest": rest})
    factor = F.max(F.when(F.col("_rest") > 0, (F.col(f"to_{m}") - F.col("_before")) / F.col("_rest"))).over(Window.partitionBy(m))
    raised = F.least(F.col("raw") * F.coalesce(factor, F.lit(0.0)), F.lit(MOST))
    return cells.withColumn("raw", raised).drop("_before", "_rest")


def half_step(margin: str) -> Column:
    held = F.sum("weight").over(Window.partitionBy(margin))
    return F.when(held > 0, F.col("weight") * F.col(f"to_{margin}") / held).otherwise(0.0)


def worst_margin(cells: DataFrame) -> float | None:
    """Largest gap between a margin's weight and its target, over values that hold weight."""
    gaps = [
        cells.groupBy(m).agg(F.sum("weight").alias("w"), F.first(f"to_{m}").alias("t")).filter("w > 0")
        .select(F.abs(F.col("w") - F.col("t")).alias("gap"))
        for m in MARGINS
    ]
    return gaps[0].unionAll(gaps[1]).unionAll(gaps[2]).agg(F.max("gap")).first()[0]


def draw_of(key: Column) -> Column:
    """Uniform in [0, 1) from the leading hex digits of an MD5 digest."""
    digits = F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary")), 1, DRAW_DIGITS)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**DRAW_DIGITS))


def cells_of(rows: DataFrame) -> DataFrame:
    return cut(
        rows.groupBy(*[F.col(f"mix_{m}").alias(m) for m in MARGINS]).agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens")),
        "mix-cells",
    )


def all_targets(cells: DataFrame, targets: dict[str, DataFrame] | None, power: float) -> dict[str, DataFrame]:
    return {m: (targets or {}).get(m) or flat_targets(cells, m, power) for m in MARGINS}


def probabilities(
    docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, power: float = FLATTEN, topic: Column | None = None,
    clip: bool = False,
) -> DataFrame:
    """``docs`` with mix_source, mix_lang, mix_topic, n_tokens, probability and kept.

    ``probability`` is rounded to 6 digits, so that the last bits of sums, which depend on
    their order, do not decide about a document.
    """
    rows = celled(without(docs, "probability", "kept", "_p"), topic)
    keys = {m: f"mix_{m}" for m in MARGINS}
    cells = cells_of(rows)
    targets = all_targets(cells, targets, power)
    if clip:
        raked = rake(cells, targets)
        total = cells.agg(F.sum("tokens")).first()[0] or 0
        p = F.least(F.lit(1.0), F.lit(budget * total) * F.col("weight") / F.col("tokens"))
    else:
        raked = rake_capped(cells, targets, budget)
        p = F.col("weight") / F.col("cap")
    p = F.when(F.col("tokens") > 0, p).otherwise(0.0)
    found = raked.select(*[F.col(m).alias(f"_{m}") for m in MARGINS], F.round(p, 6).alias("_p"))
    same = [F.col(c) == F.col(f"_{m}") for m, c in keys.items()]
    return (
        rows.join(found, same, "left").withColumn("probability", F.coalesce("_p", F.lit(0.0)))
        .drop("_p", *[f"_{m}" for m in MARGINS])
        .withColumn("kept", draw_of(F.col("doc_id")) < F.col("probability"))
    )


def shares(
    docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, power: float = FLATTEN, topic: Column | None = None
) -> DataFrame:
    """(margin, value, target, share, met): the expected sample's shares of the budget, and whether they are the targets."""
    cells = cells_of(celled(docs, topic))
    raked = rake_capped(cells, all_targets(cells, targets, power), budget)
    parts = [
        raked.groupBy(F.lit(m).alias("margin"), F.col(m).alias("value")).agg(F.first(f"want_{m}").alias("target"), F.sum("weight").alias("share"))
        for m in MARGINS
    ]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).withColumn("met", F.abs(F.col("target") - F.col("share")) <= 1e-5)


def sample(docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, power: float = FLATTEN) -> DataFrame:
    """The sampled rows of ``docs``, with their columns only."""
    return probabilities(docs, targets, budget, power).filter("kept").select(*docs.columns)
