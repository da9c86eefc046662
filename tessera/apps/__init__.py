"""Dataflows: copy detection from timed segments, identity matching."""
