"""Column expressions: the safe expression language, rates, durations, time stamps."""
