"""Column functions: each takes and returns ``Column`` and stays inside the JVM
unless its docstring says otherwise."""
