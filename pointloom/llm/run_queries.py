"""Stretches of like steps within the runs of step_records (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.runs import collapse_runs
from pointloom.sources.tables import table


def _stretches(spark: SparkSession, folder: str, at_least: int) -> DataFrame:
    steps = table(spark, folder, "step_records")
    taken = F.coalesce(F.col("accepted"), F.lit(True))
    runs = collapse_runs(steps, "run_id", "step_idx", ["cost", "delta_cost"], [taken], "recorded_at", "ingested_at", at_least=at_least)
    return runs.withColumnsRenamed({"first_pos": "first_step_idx", "last_pos": "last_step_idx", "n": "n_steps"})


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Stretches of two or more steps."""
    return _stretches(spark, folder, 2).select("run_id", "first_step_idx", "last_step_idx")


def p4_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Every run of step_records with each stretch, single steps included, as one row with its count and duration."""
    return _stretches(spark, folder, 1)


#: A run ends where more time than this lies between two of its steps, or where the means of two stretches differ by more than this part.
GAP_S, ALIKE = 3600.0, 0.05


def p4_similar(spark: SparkSession, folder: str) -> DataFrame:
    """Steps agglomerated by the likeness of whole neighbouring stretches, with a limit on the gap in time."""
    steps = table(spark, folder, "step_records")
    taken = F.coalesce(F.col("accepted"), F.lit(True))
    runs = collapse_runs(steps, "run_id", "step_idx", ["cost", "delta_cost"], [taken], "recorded_at", "ingested_at", tolerance=ALIKE, max_gap_s=GAP_S, likeness="run")
    return runs.withColumnsRenamed({"first_pos": "first_step_idx", "last_pos": "last_step_idx", "n": "n_steps"})


def _agree(c: str) -> str:
    return f"(({c} IS NULL AND p_{c} IS NULL) OR coalesce({c} = p_{c} OR abs({c} - p_{c}) <= 1e-6::DOUBLE * greatest(1.0::DOUBLE, abs(p_{c})), false))"


_RUNS = f"""
WITH once AS (
  SELECT run_id, step_idx, CASE WHEN cost::VARCHAR <> 'nan' THEN cost END AS cost, CASE WHEN delta_cost::VARCHAR <> 'nan' THEN delta_cost END AS delta_cost,
    coalesce(accepted, true) AS accepted, recorded_at
  FROM (SELECT *, row_number() OVER (PARTITION BY run_id, step_idx ORDER BY ingested_at DESC) AS turn FROM step_records) WHERE turn = 1
), lagged AS (
  SELECT *, lag(step_idx) OVER w AS p_step, lag(cost) OVER w AS p_cost, lag(delta_cost) OVER w AS p_delta_cost, lag(accepted) OVER w AS p_accepted
  FROM once WINDOW w AS (PARTITION BY run_id ORDER BY step_idx)
), marked AS (
  SELECT *, sum(CASE WHEN p_step IS NOT NULL AND accepted = p_accepted AND {_agree("cost")} AND {_agree("delta_cost")} THEN 0 ELSE 1 END)
    OVER (PARTITION BY run_id ORDER BY step_idx) AS grp FROM lagged
), runs AS (
  SELECT run_id, min(step_idx) AS first_step_idx, max(step_idx) AS last_step_idx, count(*) AS n_steps,
    epoch_us(max(recorded_at)) - epoch_us(min(recorded_at)) AS us
  FROM marked GROUP BY run_id, grp
)"""

QUERIES = {"p4_found": p4_found, "p4_runs": p4_runs, "p4_similar": p4_similar}
SQL = {
    "p4_found": f"{_RUNS} SELECT run_id, first_step_idx, last_step_idx FROM runs WHERE n_steps >= 2",
    "p4_runs": f"{_RUNS} SELECT run_id, first_step_idx, last_step_idx, n_steps, us / 1e6::DOUBLE AS duration_s FROM runs",
}
