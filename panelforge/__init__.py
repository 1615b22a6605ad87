"""Multi-panel genotype analytics as Spark DataFrame operators."""
