"""Scans, sinks and input guards."""

from caliper.sources.tables import *  # noqa: F401,F403
