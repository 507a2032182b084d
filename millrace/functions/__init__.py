"""Column functions. Each takes and returns Columns and stays inside Spark's own
expressions, so projections built from them remain in whole-stage code."""

from millrace.functions.labels import *  # noqa: F401,F403
from millrace.functions.scalars import *  # noqa: F401,F403
