"""logweave: commit-log analytics as Spark DataFrame operators.

Every operator is a function ``DataFrame -> DataFrame`` keyed by ``repo`` so
that many repositories (or one huge one) are analysed in one job.  See
``README.md`` for the operator map.
"""

__version__ = "0.1.0"
