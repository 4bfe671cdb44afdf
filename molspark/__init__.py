"""Molecule-string analytics on Spark DataFrames.

Column builders live in ``functions``, DataFrame operators in ``operators``,
readers and writers in ``sources``, the file stream in ``streaming`` and the
multi-step flows (cross-validation, discovery, report) in ``plans``.
"""

__version__ = "0.1.0"
