"""Event-time windows, time joins, changelogs and analytic operators on DataFrames."""
