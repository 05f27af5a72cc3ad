"""Mixing sources to target weights: raking, then sampling by calibrated probabilities.

Token masses are counted per cell of source, language and topic. Iterative proportional
fitting scales the cells until their sums match the target share of every source, language
and topic; a document's expected number of copies is its cell's target over its mass. Copies
are drawn with a hash of the seed and the id, so a run can be repeated: the whole part of the
expectation is sure, the rest a draw.

Without repeats (``once``) the expectations are probabilities: no cell is due more than its
mass. A member that is too small for its target is kept whole, and so is a cell; the others
are raked to share what is left of the budget in proportion to their targets. A stray document
of a new language is thus drawn for sure, and changes little else.

Everything is DataFrame functions. Texts are read once, for the cells and for the documents'
places in them; the sums, one row per cell or per member of a margin, are small but may grow
with the number of sources, so they are joined and never collected.

Rows: a null or empty text has no tokens, and weighs one so that its cell has a mass. Null
source or lang is a member of its margin, apart from the empty string. Repeated rows all
weigh, and those with the same id and cell draw alike; a null id draws like an empty one. An
empty table gives no rows. Where the cells cannot meet all targets at once, the margin that
is fitted last (the topic's) holds exactly; without repeats the limit of one copy does. Other
columns do not matter; ``mix`` keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adtally.llm.common import new_name, stored, table

#: A topic holds if its pattern has so many matches per thousand tokens; the first one rules.
TOPICS = (
    ("legal", "[Ll]icen[cs]e|[Cc]opyright", 2),
    ("table", "[|]", 60),
    ("contact", "@|[+][0-9]", 2),
    ("symbols", "[#$%&*][#$%&*]", 80),
)
OTHER_TOPIC = "prose"
TOKEN = "[^\\x20\\x09-\\x0D]+"
#: Target shares of a margin's members: their own share to this power, scaled to one.
TEMPER = {"source": 0.5, "lang": 0.5, "topic": 0.7}
DIMENSIONS = tuple(TEMPER)
SWEEPS = 12
#: Sweeps in one plan, and the cells up to which one task does them.
SWEEPS_AT_ONCE, CELLS_AT_ONCE = 4, 1_000_000
#: Tokens to be drawn, as a share of all tokens.
BUDGET = 0.5
SEED = 20240201


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKEN)).cast("bigint")


def topic_of(text: Column, tokens: Column) -> Column:
    """The first topic whose pattern is frequent enough, else the remaining one."""
    text, out = F.coalesce(text, F.lit("")), None
    for name, pattern, least in TOPICS:
        often = F.regexp_count(text, F.lit(pattern)) * 1000 >= F.greatest(tokens, F.lit(1)) * least
        out = F.when(often, name) if out is None else out.when(often, name)
    return out.otherwise(OTHER_TOPIC)


def member(column: str) -> Column:
    """A key that tells null from the empty string."""
    return F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit(""))


def placed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``cell``: their margins' members, and their mass."""
    tokens = token_count(F.col("text"))
    return docs.withColumn(
        "cell",
        F.struct(
            member("source").alias("source"),
            member("lang").alias("lang"),
            topic_of(F.col("text"), tokens).alias("topic"),
            tokens.alias("n_tokens"),
            F.greatest(tokens, F.lit(1)).alias("mass"),
        ),
    )


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """``(dimension, target)``: members' shares of the mass to a power, scaled to one."""
    raised = cells.groupBy(dimension).agg(
        F.pow(F.sum("mass").cast("double"), F.lit(power)).alias("raised")
    )
    total = F.sum("raised").over(Window.partitionBy())  # a row per member
    return raised.select(dimension, (F.col("raised") / total).alias("target"))


def filled(cells: DataFrame, dimension: str, targets: DataFrame, budget: float) -> DataFrame:
    """``targets`` at a budget of all tokens, where no member is due more than it has.

    Members too small for their target are due their whole mass; the others share the rest of
    the budget in proportion to their targets. In the order of mass over target, the members
    before the one at which the others' level is highest are the small ones. One row a member.
    """
    total = F.sum("mass").over(Window.partitionBy())
    own = cells.groupBy(dimension).agg(F.sum("mass").alias("mass"))
    members = own.select(dimension, (F.col("mass") / total).alias("own")).join(targets, dimension)
    order = Window.orderBy(F.col("own") / F.col("target"), dimension)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    given = F.coalesce(F.sum("own").over(before), F.lit(0.0))
    wanted = F.coalesce(F.sum("target").over(before), F.lit(0.0))
    levels = members.withColumn("level", (F.lit(budget) - given) / (F.lit(1.0) - wanted))
    level = F.max("level").over(Window.partitionBy())
    goal = F.least(F.col("own"), level * F.col("target")) / F.lit(budget)
    return levels.select(dimension, goal.alias("target"))


def rake(
    cells: DataFrame,
    targets: dict[str, DataFrame],
    sweeps: int = SWEEPS,
    budget: float | None = None,
) -> DataFrame:
    """``cells`` with ``weight``, whose sums match the targets; weights sum to one.

    Each sweep fits one margin after the other, by sums over windows. Cells are few as a rule
    and lie in one task then, where windows need no shuffle; more than ``CELLS_AT_ONCE`` are
    shuffled by Spark. Some sweeps are one plan, after which the cells are written. With a
    ``budget`` a sweep ends by lowering the cells due more than their mass.
    """
    count, total = cells.agg(F.count(F.lit(1)), F.sum("mass")).first()
    share = F.col("mass") / F.lit(total or 1)
    most = F.lit(float("inf")) if budget is None else share / F.lit(budget)
    for d in DIMENSIONS:
        cells = cells.join(targets[d].select(d, F.col("target").alias(f"target_{d}")), d)
    goals = [f"target_{d}" for d in DIMENSIONS]
    cells = cells.select(
        *DIMENSIONS, "mass", *goals, share.alias("weight"), most.alias("most")
    )
    for low in range(0, sweeps, SWEEPS_AT_ONCE):
        cells = stored(cells, "raked")
        if count <= CELLS_AT_ONCE:
            cells = cells.coalesce(1)
        for _ in range(low, min(sweeps, low + SWEEPS_AT_ONCE)):
            for d in DIMENSIONS:
                reached = F.sum("weight").over(Window.partitionBy(d))
                cells = cells.withColumn("weight", F.col("weight") * F.col(f"target_{d}") / reached)
            if budget is not None:
                cells = cells.withColumn("weight", F.least("weight", "most"))
    return stored(cells.select(*DIMENSIONS, "mass", "weight"), "raked")


def calibrated(
    masses: DataFrame, sweeps: int = SWEEPS, budget: float = BUDGET, once: bool = False
) -> DataFrame:
    """``(source, lang, topic, expected)``: copies that a document of each cell is due.

    With ``once`` they are at most one: what is too small for its target is kept whole.
    """
    cells = stored(masses.groupBy(*DIMENSIONS).agg(F.sum("mass").alias("mass")), "cells")
    targets = {d: tempered(cells, d, p) for d, p in TEMPER.items()}
    if once:
        targets = {d: filled(cells, d, t, budget) for d, t in targets.items()}
    raked = rake(cells, targets, sweeps, budget if once else None)
    total = cells.agg(F.sum("mass")).first()[0] or 1
    due = F.lit(budget) * F.col("weight") * F.lit(total) / F.col("mass")
    due = F.least(due, F.lit(1.0)) if once else due  # but for rounding it is that already
    return raked.select(*DIMENSIONS, due.alias("expected"))


def draw(doc_id: Column, seed: int = SEED) -> Column:
    """A number from 0 up to 1 by a hash of the seed and the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def copies(expected: Column, doc_id: Column, seed: int = SEED) -> Column:
    whole = F.floor(expected)
    return (whole + F.when(draw(doc_id, seed) < expected - whole, 1).otherwise(0)).cast("int")


def mix(
    docs: DataFrame,
    sweeps: int = SWEEPS,
    budget: float = BUDGET,
    seed: int = SEED,
    once: bool = False,
) -> DataFrame:
    """``docs`` with their number of copies, under a new name if it is taken.

    With ``once`` there is one copy or none, and the drawn rows have the target mix as far as
    there are rows for it.

    The rows meet their cell's value in a join that broadcasts the cells if they are few.
    """
    masses = placed(docs.select("text", "source", "lang")).select("cell.*")
    due = calibrated(masses, sweeps, budget, once)
    names = docs.columns
    wanted = new_name(names, "copies")
    whole = docs.select(F.struct(*names).alias("row"), "text", "source", "lang")
    joined = placed(whole).join(
        due.select(F.struct(*DIMENSIONS).alias("own"), "expected"),
        (F.col("cell.source") == F.col("own.source"))
        & (F.col("cell.lang") == F.col("own.lang"))
        & (F.col("cell.topic") == F.col("own.topic")),
    )
    return joined.select(
        "row.*", copies(F.col("expected"), F.col("row.doc_id"), seed).alias(wanted)
    )


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's cell, its expected copies, and those drawn."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    # Counted once: the texts are not read again for the join.
    own = stored(placed(docs).select("doc_id", "source", "lang", "cell"), "placed")
    due = calibrated(own.select("cell.*"))
    meet = [F.col(f"cell.{d}") == F.col(f"due.{d}") for d in DIMENSIONS]
    return own.join(due.alias("due"), meet).select(
        "doc_id",
        own["source"],
        own["lang"],
        "cell.topic",
        "cell.n_tokens",
        F.round("expected", 6).alias("expected_copies"),
        copies(F.col("expected"), F.col("doc_id")).alias("copies"),
    )


def _matches(pattern: str) -> str:
    return f"len(regexp_extract_all(coalesce(text, ''), '{pattern}'))"


def _sql() -> str:
    """The query in DuckDB's SQL, the sweeps one after another."""
    topics = " ".join(
        f"WHEN {_matches(p)} * 1000 >= greatest(n_tokens, 1) * {least} THEN '{name}'"
        for name, p, least in TOPICS
    )
    steps = [
        f"""
WITH counted AS (
  SELECT doc_id, text, source, lang,
         coalesce('=' || source, '') AS k_source, coalesce('=' || lang, '') AS k_lang,
         {_matches(TOKEN)} AS n_tokens
  FROM documents),
placed AS (
  SELECT *, greatest(n_tokens, 1) AS mass, CASE {topics} ELSE '{OTHER_TOPIC}' END AS k_topic
  FROM counted),
cells AS (
  SELECT k_source, k_lang, k_topic, CAST(sum(mass) AS DOUBLE) AS mass
  FROM placed GROUP BY ALL)"""
    ]
    for d, power in TEMPER.items():
        steps.append(
            f"""target_{d} AS (
  SELECT k_{d}, raised / sum(raised) OVER () AS target
  FROM (SELECT k_{d}, pow(sum(mass), {power}) AS raised FROM cells GROUP BY k_{d}))"""
        )
    steps.append("""step_0 AS (SELECT *, mass / sum(mass) OVER () AS weight FROM cells)""")
    k = 0
    for _ in range(SWEEPS):
        for d in DIMENSIONS:
            steps.append(
                f"""step_{k + 1} AS MATERIALIZED (
  SELECT s.k_source, s.k_lang, s.k_topic, s.mass,
         s.weight * t.target / sum(s.weight) OVER (PARTITION BY s.k_{d}) AS weight
  FROM step_{k} s JOIN target_{d} t USING (k_{d}))"""
            )
            k += 1
    steps.append(
        f"""due AS (
  SELECT k_source, k_lang, k_topic, {BUDGET} * weight * sum(mass) OVER () / mass AS expected
  FROM step_{k})"""
    )
    draw_ = (
        f"CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) "
        "AS BIGINT) / 4294967296.0"
    )
    return (
        ",\n".join(steps)
        + f"""
SELECT doc_id, source, lang, k_topic AS topic, CAST(n_tokens AS BIGINT) AS n_tokens,
       round(expected, 6) AS expected_copies,
       CAST(floor(expected) + CASE WHEN {draw_} < expected - floor(expected)
                              THEN 1 ELSE 0 END AS INTEGER) AS copies
FROM placed JOIN due USING (k_source, k_lang, k_topic)"""
    )


ORACLE = _sql()
