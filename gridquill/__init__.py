"""Document-table analytics on Spark: text normalisation, table parsing, context,
evaluation, claim linking and corpus preparation as DataFrame operators."""

__version__ = "0.1.0"
