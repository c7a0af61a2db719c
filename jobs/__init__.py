"""Runnable jobs: each module has run(spark, ...) and a command line, and reads a small JSON config beside it."""
