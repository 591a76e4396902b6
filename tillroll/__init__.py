"""Order-line analytics on Spark: cleaning, profiling, normalisation and commercial metrics."""

from tillroll.functions.columns import RETAIL, LineColumns
from tillroll.session import build_session

__all__ = ["RETAIL", "LineColumns", "build_session"]
