"""Column functions over strings, dates and sizes; all run inside the JVM unless their text says otherwise."""
