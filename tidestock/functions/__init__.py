"""Column expressions. Everything here returns a ``Column`` and stays inside the JVM."""
