"""Scalar functions of the dialect where Spark's own differ from what queries expect."""
