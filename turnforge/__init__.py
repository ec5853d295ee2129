"""turnforge: a Spark-native engine for building, validating and grading
multilingual chat-dialogue corpora as tables.

Everything relational is DataFrame code over built-in Spark expressions; the
language model sits behind a pluggable batch-completion backend
(``turnforge.operators.complete``).
"""

__version__ = "0.1.0"
