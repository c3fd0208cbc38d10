"""Stages and pipelines composed of operators, and the command line."""
