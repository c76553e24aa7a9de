"""The corpus pipeline, as ``graphloom.llm.pipeline`` defines it: STAGES, run and ORACLE_SQL."""

from graphloom.llm.pipeline import ORACLE_SQL, STAGES, decontaminate, near_dedup, pack, quality_rules, run, sanitise

__all__ = ["ORACLE_SQL", "STAGES", "decontaminate", "near_dedup", "pack", "quality_rules", "run", "sanitise"]
