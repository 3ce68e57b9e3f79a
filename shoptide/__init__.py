"""Real-time shop warehouse on PySpark: CDC routing, dimensions, order facts, wide orders, daily actives."""
