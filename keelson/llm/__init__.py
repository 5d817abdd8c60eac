"""Training-data pipeline operators.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` registers
its queries only when it is present.
"""
