"""Input tables and result sinks."""
