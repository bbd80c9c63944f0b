"""flowlab: Spark-native analytics for labelled network-flow tables.

Every public operator is a function DataFrame -> DataFrame (or a fitted
object whose ``apply`` is one).  Heavy work stays inside Spark; the driver
only ever sees bounded results: fitted statistics, class lists, model
parameters and small result tables.
"""

from flowlab.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
