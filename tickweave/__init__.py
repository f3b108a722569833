"""Process-data analytics on Spark: tick-indexed sensor logs of many plants, checked,
aligned, windowed, scored and accounted for with DataFrame operators."""

from tickweave.contract import Tables

__all__ = ["Tables"]
