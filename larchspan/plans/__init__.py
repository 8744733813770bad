"""The catalogue of queries: name -> Spark callable, and name -> SQL."""

from larchspan.plans import baseline, climate, detection, incremental, indices, masks, objects, radar, signal, statistics, supplement, validation  # noqa: F401
from larchspan.plans.kit import ORACLE, QUERIES  # noqa: F401
