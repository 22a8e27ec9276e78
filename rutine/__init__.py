"""Routine discovery over ordered event logs, as DataFrame operators."""
