"""Traffic analytics and anomaly detection as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

from tidegauge.config import DetectionConfig, FeatureConfig, TrainingConfig

# The few Python functions that run in tasks travel with the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["DetectionConfig", "FeatureConfig", "TrainingConfig"]
