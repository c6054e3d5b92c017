"""Panel operators: each takes a Panel and returns one."""
