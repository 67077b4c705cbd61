"""Recommendation and catalogue search as Spark jobs.

Every public function takes and returns DataFrames.  ``sources`` and ``sinks``
read and write, ``functions`` holds column expressions, ``operators`` the
reusable joins, rankings, splits and scoring, ``plans`` the end-to-end jobs.
"""
