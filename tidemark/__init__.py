"""Spark-first liquidity analytics: lazy DataFrame-to-DataFrame operators."""
