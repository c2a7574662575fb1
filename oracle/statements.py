"""All expected results by query name."""

from __future__ import annotations

from oracle.analysis import analysis_statements
from oracle.models import model_statements


def all_statements() -> dict[str, str]:
    return {**model_statements(), **analysis_statements()}
