"""Incident analytics as Spark DataFrame operators.

Every operator takes DataFrames and returns a DataFrame (or a small fitted
object made of DataFrames).  Catalyst plans the work; nothing row-level is
collected to the driver.
"""
from precinct.schema import Roles
from precinct.session import build_session, settle

__all__ = ["Roles", "build_session", "settle"]
