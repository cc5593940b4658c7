"""Tables written to the shared folder, to cut lineage: a lost executor doesn't
lose them, and nothing before is computed twice."""

from tracelake.session import scratch as new_path
from tracelake.session import stored as written

__all__ = ["new_path", "written"]
