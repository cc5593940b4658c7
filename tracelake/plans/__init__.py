from tracelake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
