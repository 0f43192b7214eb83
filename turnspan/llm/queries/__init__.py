"""One module for each query; importing them registers them."""

from . import op1, op10, op2, op3, op4, op5, op6, op7, op8, op9  # noqa: F401
