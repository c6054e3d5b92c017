"""Panel analytics on Spark: DataFrames of numeric features keyed by an integer time and a unit."""

from .panel import Panel

__version__ = "0.1.0"
__all__ = ["Panel"]
