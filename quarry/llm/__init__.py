"""Training-data operators: dedup, scoring, scanning, tokenising, mixing.

Self-contained: nothing else in the library imports this package.
"""
