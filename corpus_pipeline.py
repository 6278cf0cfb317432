"""The corpus pipeline: score, filter, de-duplicate, redact and pack the documents, one written stage after the other."""

from __future__ import annotations

from fraylens.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
