"""The detection metrics and the building blocks they share."""
