"""Availability estimates and demand analytics as Spark jobs.

``sources`` reads and writes the tables, ``functions`` holds column expressions,
``operators`` the DataFrame operators, ``plans`` the end-to-end queries and
``streaming`` the Structured Streaming versions.
"""
