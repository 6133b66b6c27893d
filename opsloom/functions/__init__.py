"""Column expressions: everything here is ``Column -> Column`` and stays in the JVM."""
