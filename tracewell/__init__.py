"""tracewell: failure analysis of multi-agent workflow traces as Spark jobs.

Every operator takes DataFrames holding *many* runs and returns a DataFrame
keyed by ``run_id``; nothing in the package loops over runs on the driver.
"""

from tracewell.config import Config

__all__ = ["Config"]
