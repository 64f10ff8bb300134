"""Operator 10, mixing sources to target weights: balanced sampling by the cube method.

Each source gets one inclusion probability, so that the expected token shares of
the sample are the target weights. The sample is the largest in which sources
too small for their weights miss at most ``miss`` of it together, and has at least
the share ``keep`` of the tokens; so a tiny source, as of mistyped or null names,
doesn't thin the others. A source that is too small is taken whole, and what it
lacks is shared among the others by their weights. The cube method then turns probabilities
into a 0/1 sample that keeps both totals, documents and tokens, of every
source: a unit's fractional value moves along the null space of the two
balancing constraints, by a random step of mean 0, until it lands on 0 or 1.

Flight runs in blocks of bounded size, in parallel. A block leaves at most two
fractional units, which meet those of other blocks on the next level; levels
follow until one block per source is left. Then the sources' last units fly
together under the totals of the whole corpus, and the at most two of them that
stay fractional land by dropping first the token, then the document constraint.

Defined results: a null source is a source of its own, null texts have 0 tokens.
Rows equal in id, source and text are one unit with their joint totals, so they stay
or go together. A source without tokens keeps all its documents. Sources
without a given weight have weight 0 and aren't sampled. Ids may be null.
The sample depends on ``seed`` and the rows, not on partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Stored, by_keys

EDGE = 1e-9


@dataclass(frozen=True)
class MixParams:
    weights: dict | None = None  #: source -> target share of tokens; None: by the power ``alpha`` of its tokens
    alpha: float = 0.5
    rate: float = 1.0  #: sample size, as a share of the largest that ``miss`` and ``keep`` allow
    miss: float = 0.01  #: share of the sample that sources may fall short of their weights together
    keep: float | None = None  #: least share of the tokens, at rate 1, whatever is missed; None: 0.5 for weights by ``alpha``, 0 for given ones
    block: int = 2048  #: units in a block of the flight phase
    seed: int = 13


def fly(x: np.ndarray, n: np.ndarray, t: np.ndarray, pi: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight phase of one block: values near 0 or 1 but for at most two units.

    Keeps sum(x * n / pi) and sum(x * t / pi), the estimates of both totals.
    """
    out = x.tolist()
    a, b = (n / pi).tolist(), (t / pi).tolist()
    draw = rng.random(2 * len(out) + 2).tolist()
    hand: list[int] = []
    at = 0
    for unit in range(len(out)):
        if EDGE < out[unit] < 1 - EDGE:
            hand.append(unit)
        if len(hand) < 3:
            continue
        i, j, m = hand
        u = (a[j] * b[m] - a[m] * b[j], a[m] * b[i] - a[i] * b[m], a[i] * b[j] - a[j] * b[i])
        big = max(abs(u[0]), abs(u[1]), abs(u[2]))
        if big <= 1e-12 * max(1.0, a[i] * b[j], a[j] * b[m], a[m] * b[i]):
            # both constraints agree on these units: two of them can trade
            u = (a[j], -a[i], 0.0) if a[i] or a[j] else (1.0, -1.0, 0.0)
        up = down = float("inf")
        for unit_, step in zip(hand, u):
            if step > 0:
                up, down = min(up, (1 - out[unit_]) / step), min(down, out[unit_] / step)
            elif step < 0:
                up, down = min(up, out[unit_] / -step), min(down, (1 - out[unit_]) / -step)
        move = up if draw[at] * (up + down) < down else -down
        at += 1
        for unit_, step in zip(hand, u):
            v = out[unit_] + move * step
            out[unit_] = 0.0 if v < EDGE else 1.0 if v > 1 - EDGE else v
        hand = [h for h in hand if EDGE < out[h] < 1 - EDGE]
    return np.array(out)


def land(x: np.ndarray, n: np.ndarray, t: np.ndarray, pi: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Last units: flight under both totals, then under documents alone, then a plain draw."""
    x = fly(x, n, t, pi, rng)
    left = np.flatnonzero((x > EDGE) & (x < 1 - EDGE))
    while len(left) >= 2:
        i, j = left[:2]
        u = np.array([n[j] / pi[j], -n[i] / pi[i]])
        v = x[[i, j]]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.min(np.where(u > 0, (1 - v) / u, np.where(u < 0, -v / u, np.inf)))
            down = np.min(np.where(u > 0, v / u, np.where(u < 0, (v - 1) / u, np.inf)))
        x[[i, j]] = v + (up if rng.random() * (up + down) < down else -down) * u
        left = np.flatnonzero((x > EDGE) & (x < 1 - EDGE))
    for i in left:
        x[i] = float(rng.random() < x[i])
    return (x > 0.5).astype(float)


def inclusion(tokens: dict, params: MixParams) -> dict:
    """Inclusion probability of each source: in proportion to weight per token, but 1 for sources too small for their weight."""
    p = params
    weights = {s: (n**p.alpha if n else 0.0) for s, n in tokens.items()} if p.weights is None else {s: max(0.0, float(p.weights.get(s, 0))) for s in tokens}
    keep = (0.5 if p.weights is None else 0.0) if p.keep is None else p.keep
    live = sorted((s for s, n in tokens.items() if n and weights[s]), key=lambda s: tokens[s] / weights[s])
    out = {s: 0.0 if n else 1.0 for s, n in tokens.items()}
    whole, total = float(sum(tokens[s] for s in live)), sum(weights[s] for s in live)
    # the sources that fall short are the first ones; at size x they miss weight / total - tokens / x
    size, weight, held = whole, 0.0, 0.0
    for s in live:
        weight, held = weight + weights[s], held + tokens[s]
        if weight / total > p.miss:
            size = min(size, held / (weight / total - p.miss))
    size = p.rate * max(size, keep * whole)
    for s in live:
        share = size * weights[s] / (total * tokens[s])
        out[s] = min(1.0, share)
        if share >= 1:
            size, total = size - tokens[s], total - weights[s]
    return out


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit("\\S+")), F.lit(0)).cast("long")


def mix_sources(docs: DataFrame, params: MixParams = MixParams(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, n_tokens, probability, selected), one row for each row of the table."""
    return _mixed(docs, params, id_col, text_col, source_col).select("doc_id", "source", F.col("n_tokens").alias("n_tokens"), "probability", "selected", F.explode(F.sequence(F.lit(1), "copies")).alias("_")).drop("_")


def _mixed(docs: DataFrame, p: MixParams, id_col: str, text_col: str, source_col: str) -> DataFrame:
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(text).alias("tie"), word_count(text).alias("n_tokens"))
    units = Stored(rows.groupBy("doc_id", "source", "tie").agg(F.count("*").cast("int").alias("copies"), F.first("n_tokens").alias("n_tokens")), "units")
    sums = units.df.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("units")).collect()  # one row per source
    pi = inclusion({r["source"]: r["tokens"] for r in sums}, p)
    source_type = units.df.schema["source"].dataType
    table = spark.createDataFrame([(r["source"], i, float(pi[r["source"]]), r["units"]) for i, r in enumerate(sorted(sums, key=lambda r: (r["source"] is not None, str(r["source"]))))], _schema(source_type))
    unit = F.xxhash64("doc_id", "source", "tie")
    probed = units.df.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("s"))).withColumn("unit", unit)
    fractional = probed.where((F.col("probability") > EDGE) & (F.col("probability") < 1 - EDGE))
    most = max((r["units"] for r in sums if EDGE < pi[r["source"]] < 1 - EDGE), default=0)
    flying = Stored(fractional.select("number", "unit", (F.col("copies").cast("double")).alias("n"), (F.col("n_tokens") * F.col("copies")).cast("double").alias("t"), F.col("probability").alias("pi"), F.col("probability").alias("x"), "units"), "flight")
    schema = "number int, unit long, n double, t double, pi double, x double, units long"
    settled, level, block, seed = [], 0, p.block, p.seed
    while most:
        blocks = F.ceil(F.col("units") / F.lit(float(block))).cast("long")
        key = F.pmod(F.xxhash64("unit", F.lit(seed + level)), blocks)

        moved = Stored(flying.df.withColumn("block", key).groupBy("number", "block").applyInPandas(_flight(seed, level), schema), "flight")
        flying.drop()
        landed = (F.col("x") <= EDGE) | (F.col("x") >= 1 - EDGE)
        settled.append(moved.df.where(landed).select("unit", (F.col("x") > 0.5).alias("taken")))
        blocks_now = -(-most // block)
        left = moved.df.where(~landed)
        if blocks_now <= 1:
            # at most two units per source: a small problem, whatever the corpus
            rest = left.select("number", "unit", "n", "t", "pi", "x").orderBy("number", "unit").toPandas()
            if len(rest):
                got = land(*(rest[c].to_numpy().astype(float) for c in ("x", "n", "t", "pi")), np.random.default_rng(seed))
                settled.append(spark.createDataFrame([(int(u), bool(v > 0.5)) for u, v in zip(rest["unit"], got)], "unit long, taken boolean"))
            break
        # every block left two units at most
        flying = Stored(left.withColumn("units", F.least("units", blocks * 2)), "flight")
        most, level = 2 * blocks_now, level + 1
    if not settled:
        flying.drop()
        return probed.withColumn("selected", F.col("probability") > 0.5)
    sample = settled[0]
    for more in settled[1:]:
        sample = sample.unionByName(more)
    # units whose hashes collide share one decision, and no row is doubled
    sample = sample.groupBy("unit").agg(F.max("taken").alias("taken"))
    return probed.join(sample, "unit", "left").withColumn("selected", F.coalesce("taken", F.col("probability") > 0.5))


def _flight(seed: int, level: int):
    def flight(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop(columns="block").sort_values(["unit", "t"], kind="stable")
        rng = np.random.default_rng([seed, level, int(pdf["number"].iloc[0]), int(pdf["unit"].iloc[0]) & 0xFFFFFFFF])
        pdf = pdf.iloc[rng.permutation(len(pdf))]
        return pdf.assign(x=fly(*(pdf[c].to_numpy() for c in ("x", "n", "t", "pi")), rng))

    return flight


def _schema(source_type):
    from pyspark.sql import types as T

    return T.StructType([T.StructField("s", source_type), T.StructField("number", T.IntegerType()), T.StructField("probability", T.DoubleType()), T.StructField("units", T.LongType())])


def sample_documents(docs: DataFrame, params: MixParams = MixParams(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The selected rows with all their columns. Narrow keys of the others filter the table, see ``by_keys``."""
    gone = Stored(_mixed(docs, params, id_col, text_col, source_col).where(~F.col("selected")).select("doc_id", "source", "tie").distinct(), "gone")
    return by_keys(docs, gone, {"doc_id": F.col(id_col), "source": F.col(source_col), "tie": F.xxhash64(text_col)}, "left_anti")
