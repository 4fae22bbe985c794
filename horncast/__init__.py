"""horncast: deductive analytics (Horn rules, equality, existentials) on Spark DataFrames."""

from .lang.errors import MorphismCycleError, TheoryError
from .model import Model, Theory, load_theories, load_theory, reopen
from .operators.engine import LimitExceeded

__all__ = ["LimitExceeded", "Model", "MorphismCycleError", "Theory", "TheoryError", "load_theories", "load_theory", "reopen"]
