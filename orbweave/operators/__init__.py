"""The graph model, vertex programs, the engine that runs them, and the algorithms it ships with."""
