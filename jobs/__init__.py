"""Runnable jobs: each module has a ``run`` that takes a session and paths, and a command line."""
