"""Multi-operator plans and the helpers that keep them scalable."""
