"""The query modules of the library."""

from . import analyzers, core_training, planted, progress_plans, relational

MODULES = [core_training, relational, analyzers, planted, progress_plans]
