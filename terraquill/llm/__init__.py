"""Training-corpus operators: ten DataFrame-in, DataFrame-out steps that share only ``common``."""
