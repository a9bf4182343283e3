"""Column expressions: everything here stays inside the JVM unless its name says otherwise."""
