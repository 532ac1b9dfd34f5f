"""Hourly sensor-network and gridded-field analytics on Spark DataFrames."""

from hourgrid.session import build_session, pin_session

__all__ = ["build_session", "pin_session"]
