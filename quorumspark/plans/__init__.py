"""All queries of the library but those of the training-data operators."""

from quorumspark.plans import contrasts, errors, evidence, inference, leakage, panels, panelsize, streams  # noqa: F401
from quorumspark.plans.registry import ORACLES, QUERIES  # noqa: F401
