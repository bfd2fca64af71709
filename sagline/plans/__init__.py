"""The three end-to-end plans."""

from sagline.plans.classes import class_summary
from sagline.plans.extract import extract_power_lines
from sagline.plans.wires import wire_summary

__all__ = ["class_summary", "extract_power_lines", "wire_summary"]
