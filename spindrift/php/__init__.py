"""A small PHP front end: tokens, syntax trees, control flow, SSA, abstract interpretation and types of one file.

These are interpreters whose order matters, so they run in Python for each file on its own, and give rows.
"""
