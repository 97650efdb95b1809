"""Column expressions: null rules, time, symbols, rolling frames."""
