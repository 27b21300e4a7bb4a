"""plumbline: governed multi-stage data pipelines as PySpark DataFrame operators."""
