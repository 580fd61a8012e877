"""Operators for preparing training data at corpus scale.

Nothing outside this folder imports it; the rest of the library works without it.
"""
