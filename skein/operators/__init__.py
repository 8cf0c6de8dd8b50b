"""The search, stage by stage, on an ``Index`` of quantized vectors."""
