"""DataFrame -> DataFrame operators of the journey model."""
