"""Multi-operator plans: evaluation, replay, validation."""
