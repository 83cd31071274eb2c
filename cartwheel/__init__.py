"""cartwheel: web-shop reporting and table cleaning as Spark DataFrame operators.

Layout
------
sources/    table schemas, CSV in/out, the web-shop views over the test tables
functions/  Column-level semantics helpers (ratios, period keys, rounding)
operators/  parametrised DataFrame -> DataFrame operators (reports, funnel, A/B, profile, clean)
plans/      the configured reports and cleaning runs exposed as named queries
streaming/  running the report operators over a streaming source
"""

__all__ = ["session"]
