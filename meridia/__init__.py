"""meridia: subject-level analytics as Spark DataFrame operators."""

from meridia.session import build_session, clear_scratch, durable, ship

__all__ = ["build_session", "clear_scratch", "durable", "ship"]
