"""Models and operators on observation matrices."""
