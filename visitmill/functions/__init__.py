"""Column expressions: text cleaning, addresses, durations, times, labels."""
