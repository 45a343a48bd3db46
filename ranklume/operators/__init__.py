"""Operators over frames: lazy, without actions."""
