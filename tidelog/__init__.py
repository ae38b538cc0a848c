"""A Spark-first engine for change logs: decode, route, transform, apply and watch row changes."""
