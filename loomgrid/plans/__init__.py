"""Whole analyses: telemetry of runs, and the harness that makes runs."""
