"""llm of the engine."""
