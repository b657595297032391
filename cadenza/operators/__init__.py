"""Transforms, checks and metrics over a corpus."""

from cadenza.operators.evaluate import evaluate
from cadenza.operators.filter_by import filter_by
from cadenza.operators.resample import to_times
from cadenza.operators.trim import trim
from cadenza.operators.validate import violations

__all__ = ["evaluate", "filter_by", "to_times", "trim", "violations"]
