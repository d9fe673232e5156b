from . import patterns, text, vectors  # noqa: F401
