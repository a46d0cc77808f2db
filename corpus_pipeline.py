"""The corpus pipeline; its stages are in ``strandline.llm.pipeline``."""

from strandline.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
