"""Composite plans: master build (C1, C5), train-and-evidence run (C4), and the role
binding of the driver's tables to the operators' inputs."""
