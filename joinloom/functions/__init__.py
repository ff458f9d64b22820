from .expressions import Expression, col, ieee_divide, ieee_ln, ieee_remainder, lit  # noqa: F401
