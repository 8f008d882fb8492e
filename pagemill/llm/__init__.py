"""Operators of a training-data pipeline, one module each; ``queries`` applies them to whole tables."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: what runs there travels with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
