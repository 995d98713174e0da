"""Training-data operators: one module each, plus the queries that apply them to the driver's tables.

Nothing outside this subpackage imports it. Modules are imported on demand, because Python workers
load only the one that a task needs.
"""
