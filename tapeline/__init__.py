"""Spark jobs over keyed event topics: fills, clearing events, positions, reports, reference data.

Every public operator is a plain ``DataFrame -> DataFrame`` function built from
the DataFrame API, so Catalyst and adaptive execution plan it.
"""

__version__ = "0.1.0"
