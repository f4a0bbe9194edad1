"""Column -> Column builders (scalar functions F1–F21, P8, P14, J9)."""

from caliper.functions.columns import *  # noqa: F401,F403
