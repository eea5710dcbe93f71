"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed by cell (source, language, topic). A source, language or topic is wanted with
its tokens' share to the power ``ALPHA``, as far as its tokens, each used up to ``most`` times, are
enough for a budget of tokens; what they can't fill goes to the others in proportion. The cells' weights are raked
in turn to these margins, where a cell counts with no more than its tokens ``most`` times: full
cells stay full while the rest is raked on. A cell's weight by its tokens is the calibrated rate of its
documents: the whole part of it counts as copies, and a hash of the id under the fractional part as one
more, so any rerun keeps the same documents. With ``most`` 1 the rate is a probability.

Cells are few as a rule: up to ``LOCAL_CELLS`` they are raked on the driver and broadcast; beyond that
the same steps are DataFrame jobs, and the rates are joined by shuffle.

Edge cases: null margins are a value of their own (empty text); null and empty texts have no tokens and
the rate of their cell, or 1 where the cell has no tokens; a null id hashes like the empty text; an
empty table gives an empty result. Extra columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm._tables import save

LOCAL_CELLS = 100_000
SWEEPS = 20
#: Target shares are the tokens' shares to this power, which lifts small sources and languages.
ALPHA = 0.5
#: Part of all tokens to keep, and how often a document is used at most.
BUDGET = 0.8
MOST = 4.0
MARGINS = ("source", "lang", "topic")


def token_count(text: Column) -> Column:
    """Words of a text (0 for null)."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\x0B\\f\\r]+")), F.lit(0)).cast("long")


def structural_topic(text: Column) -> Column:
    """A topic by structure: tables, legal notices, marked-up words, prose."""
    return F.when(text.contains(" | "), "table").when(text.contains("icens"), "legal").when(text.contains("***"), "marked").otherwise("prose")


def unit_hash(doc_id: Column, salt: str = "mix") -> Column:
    """A number in [0, 1) from the id alone."""
    named = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{salt}"))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def fill(have: np.ndarray, share: np.ndarray, budget: float, most: float) -> np.ndarray:
    """Tokens of each value of a margin: the budget by shares, none with more than ``most`` times its tokens."""
    order = np.argsort(have / share, kind="stable")
    full, part = most * have[order], share[order]
    spent, left = np.cumsum(full) - full, np.cumsum(part[::-1])[::-1]
    rate = (budget - spent) / left
    level = rate[np.argmax(rate <= full / part)]
    return np.minimum(most * have, level * share)


def wanted(cells: pd.DataFrame, alpha: float, budget: float, most: float) -> dict[str, dict[str, float]]:
    """Tokens of every source, language and topic in the mixture."""
    out = {}
    for m in MARGINS:
        have = cells[cells["tokens"] > 0].groupby(m)["tokens"].sum().astype(float)
        out[m] = dict(zip(have.index, fill(have.to_numpy(), have.to_numpy() ** alpha, budget, most), strict=True)) if len(have) else {}
    return out


def rake(cells: pd.DataFrame, targets: dict[str, dict[str, float]], budget_part: float, most: float, sweeps: int = SWEEPS) -> np.ndarray:
    """Rate of each cell, so that the margins of rate times tokens are the targets; 1 for cells without tokens."""
    t = cells["tokens"].to_numpy(float)
    w = budget_part * t
    codes = {m: pd.factorize(cells[m]) for m in targets}
    for _ in range(sweeps):
        for m, (code, names) in codes.items():
            have = np.bincount(code, np.minimum(w, most * t), len(names))
            want = np.array([targets[m].get(n, 0.0) for n in names])
            w = w * np.divide(want, have, out=np.zeros_like(want), where=have > 0)[code]
    return np.divide(np.minimum(w, most * t), t, out=np.ones_like(t), where=t > 0)


def _rake_wide(cells: DataFrame, alpha: float, budget_part: float, most: float, sweeps: int) -> DataFrame:
    """The steps of ``wanted`` and ``rake`` for any number of cells."""
    cells = save(cells)
    budget = budget_part * (cells.agg(F.sum("tokens")).first()[0] or 0)
    targets = {}
    for m in MARGINS:
        values = save(cells.where("tokens > 0").groupBy(m).agg(F.sum("tokens").cast("double").alias("have")).withColumn("share", F.pow("have", F.lit(alpha))))
        level, full = 0.0, -1
        while True:  # values that a level fills are full at every later, higher one
            over = F.col("have") * most <= F.lit(level) * F.col("share")
            now = values.agg(F.count_if(over).alias("full"), F.sum(F.when(over, F.col("have") * most)).alias("spent"), F.sum(F.when(~over, F.col("share"))).alias("left")).first()
            if now["full"] == full or not now["left"]:
                break
            full, level = now["full"], (budget - (now["spent"] or 0.0)) / now["left"]
        targets[m] = save(values.select(m, F.least(F.col("have") * most, F.lit(level) * F.col("share")).alias("want")))
    used = F.least(F.col("w"), F.col("tokens") * most)
    now = cells.withColumn("w", F.col("tokens") * F.lit(float(budget_part)))
    for _ in range(sweeps):
        for m in MARGINS:
            factor = now.groupBy(m).agg(F.sum(used).alias("have")).join(targets[m], m, "left").select(m, F.coalesce(F.try_divide("want", "have"), F.lit(0.0)).alias("f"))
            now = save(now.join(factor, m).withColumn("w", F.col("w") * F.col("f")).drop("f"))
    return now.select(*MARGINS, F.coalesce(F.try_divide(used, F.col("tokens")), F.lit(1.0)).alias("rate"))


def rates(cells: DataFrame, alpha: float = ALPHA, budget_part: float = BUDGET, most: float = MOST, sweeps: int = SWEEPS, local: int = LOCAL_CELLS) -> tuple[DataFrame, bool]:
    """Rate of each cell, and whether the table is small enough to broadcast."""
    head = cells.limit(local + 1).toPandas()
    if len(head) > local:
        return _rake_wide(cells, alpha, budget_part, most, sweeps), False
    head = head.sort_values(list(MARGINS), kind="stable").reset_index(drop=True)
    targets = wanted(head, alpha, budget_part * float(head["tokens"].sum()), most)
    head["rate"] = rake(head, targets, budget_part, most, sweeps)
    schema = ", ".join(f"{m} string" for m in MARGINS) + ", rate double"
    return cells.sparkSession.createDataFrame(head[[*MARGINS, "rate"]], schema), True


def copies(doc_id: Column, rate: Column) -> Column:
    """How often a document is in the mixture."""
    return (F.floor(rate) + (unit_hash(doc_id) < rate - F.floor(rate)).cast("int")).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None, alpha: float = ALPHA, budget_part: float = BUDGET, most: float = MOST, local: int = LOCAL_CELLS) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, rate and copies (0: not kept) of every document; one row each, as in the input."""
    measured = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(structural_topic(F.col(text_col)) if topic is None else topic, F.lit("")).alias("topic"), token_count(F.col(text_col)).alias("n_tokens"),
    )
    measured = save(measured)
    found, small = rates(measured.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")), alpha, budget_part, most, local=local)
    joined = measured.join(F.broadcast(found) if small else found, list(MARGINS))
    return joined.select("doc_id", *MARGINS, "n_tokens", F.round("rate", 6).alias("rate"), copies(F.col("doc_id"), F.col("rate")).alias("copies"))


def margins(mixed: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """margin, value, share of all tokens, share wanted by the power, and share of the kept tokens with their copies; ``mixed`` as from ``mix``."""
    sums = mixed.select(F.explode(F.array(*[F.struct(F.lit(m).alias("margin"), F.col(m).alias("value")) for m in MARGINS])).alias("m"), "n_tokens", "copies")
    sums = sums.groupBy("m").agg(F.sum("n_tokens").cast("double").alias("have"), F.sum(F.col("n_tokens") * F.col("copies")).cast("double").alias("kept"))
    sums = save(sums.select("m.*", "have", F.pow("have", F.lit(alpha)).alias("power"), "kept"))
    whole = sums.groupBy("margin").agg(*(F.sum(c).alias(f"all_{c}") for c in ("have", "power", "kept")))
    return sums.join(whole, "margin").select("margin", "value", *(F.try_divide(F.col(c), F.col(f"all_{c}")).alias(n) for c, n in (("have", "input_share"), ("power", "wanted_share"), ("kept", "kept_share"))))


def sample(docs: DataFrame, budget_part: float = BUDGET) -> DataFrame:
    """The rows of documents that a mixture without repetition keeps, all columns as they are. Texts aren't shuffled while the cells are few."""
    taken = {c.lower() for c in docs.columns}
    key, topic = (next(n for i in range(len(taken) + 1) if (n := f"_{x}{i}") not in taken) for x in ("cell", "topic"))
    keyed = docs.withColumn(topic, F.coalesce(structural_topic(F.col("text")), F.lit("")))
    cell = F.struct(F.coalesce(F.col("source"), F.lit("")).alias("source"), F.coalesce(F.col("lang"), F.lit("")).alias("lang"), F.col(topic).alias("topic"))
    cells = keyed.groupBy(cell.alias("c")).agg(F.sum(token_count(F.col("text"))).alias("tokens")).select("c.*", "tokens")
    found, small = rates(cells, budget_part=budget_part, most=1.0)
    found = found.select(F.struct(*MARGINS).alias(key), "rate").select(key, F.col("rate").alias(f"{key}_rate"))
    met = keyed.withColumn(key, cell).join(F.broadcast(found) if small else found, key)
    return met.where(unit_hash(F.col("doc_id")) < F.col(f"{key}_rate")).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle(alpha: float = ALPHA, budget_part: float = BUDGET, most: float = MOST, sweeps: int = SWEEPS) -> str:
    """The query in DuckDB SQL: the sweeps are unrolled over the cells."""
    steps, last = [], "cells"
    for i in range(sweeps):
        for m in MARGINS:
            name = f"r{i}_{m}"
            steps.append(f"{name} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.tokens, c.w * t.want / sum(least(c.w, {most} * c.tokens)) OVER (PARTITION BY c.{m}) AS w FROM {last} c JOIN t_{m} t USING ({m}))")
            last = name
    targets = ", ".join(
        f"""o_{m} AS MATERIALIZED (
  SELECT *, coalesce(sum(full_at) OVER (ORDER BY full_at / share, {m} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
         sum(share) OVER (ORDER BY full_at / share, {m} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_share
  FROM (SELECT {m}, {most} * sum(tokens) AS full_at, power(sum(tokens), {alpha}) AS share FROM cells GROUP BY {m})),
l_{m} AS (SELECT min_by((budget - spent) / open_share, full_at / share) FILTER ((budget - spent) / open_share <= full_at / share) AS level FROM o_{m}, budget),
t_{m} AS MATERIALIZED (SELECT {m}, least(full_at, level * share) AS want FROM o_{m}, l_{m})"""
        for m in MARGINS
    )
    return f"""
WITH m AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
         CASE WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, 'icens') THEN 'legal' WHEN contains(text, '***') THEN 'marked' ELSE 'prose' END AS topic,
         CAST(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')), 0) AS BIGINT) AS n_tokens
  FROM documents),
cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens, CAST(sum(n_tokens) AS DOUBLE) * {budget_part} AS w FROM m GROUP BY ALL HAVING sum(n_tokens) > 0),
budget AS (SELECT sum(tokens) * {budget_part} AS budget FROM cells),
{targets},
{", ".join(steps)},
p AS (SELECT source, lang, topic, least(w, {most} * tokens) / tokens AS rate FROM {last}),
d AS (SELECT m.*, coalesce(p.rate, 1.0) AS rate, CAST('0x' || substr(md5(concat(coalesce(CAST(m.doc_id AS VARCHAR), ''), ':mix')), 1, 8) AS BIGINT) / 4294967296.0 AS u
      FROM m LEFT JOIN p USING (source, lang, topic))
SELECT doc_id, source, lang, topic, n_tokens, round(rate, 6) AS rate, CAST(floor(rate) AS BIGINT) + CAST(u < rate - floor(rate) AS BIGINT) AS copies
FROM d"""
