"""A cleaning pipeline over documents: every stage is written as Parquet and reread as the next one's input."""

from __future__ import annotations

from sheetwise.llm import stages

STAGES = stages.STAGES
#: Newton steps, covariance estimates and connected components have no plain SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage."""
    return stages.run(spark, sf_dir)
