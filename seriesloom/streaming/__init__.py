"""Intentionally empty: the capability set has no streaming operator.

All inputs are whole files, so every operator is a batch DataFrame plan.
"""
