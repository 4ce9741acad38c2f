"""Exact long-run analysis of discrete stochastic systems on Spark."""
