"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames, names its columns by parameter and keeps its own working columns
under the prefix ``__gl_`` so that extra input columns never clash.
"""
