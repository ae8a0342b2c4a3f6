"""Streaming.

The analysed project is a batch statistics workload: it has no streams,
event time, watermarks or stateful operators, so this package holds no
operators.  Every operator in the library is a DataFrame → DataFrame function
and runs unchanged on a streaming DataFrame where Spark supports the
underlying relational operator (projections, filters, scalar expressions);
order statistics and iterative fits are batch-only.
"""
