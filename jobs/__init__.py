"""Runnable jobs over the engine's operators; each has a command line and a small config file beside it."""
