"""Algorithms on the things of one page, in plain Python and numpy, for the operators that run them a page at a time."""
