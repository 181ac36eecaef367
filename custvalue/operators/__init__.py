"""Table operators, each ``DataFrame -> DataFrame``."""
