"""Tables and documents that the engine writes."""
