"""Slot-driven tracking: state tables and the stream around them."""
