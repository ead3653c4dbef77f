"""A strict SELECT dialect over 64-bit integers and strings, run by Spark."""
