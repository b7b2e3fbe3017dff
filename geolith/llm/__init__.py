"""Training-data operators: ten corpus-scale text operators as Spark jobs.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries only when it can be imported.
"""
