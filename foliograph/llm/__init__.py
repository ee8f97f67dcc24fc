"""Training-data operators: ten corpus-cleaning operators and their queries.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries
only where it can be imported.
"""
