"""Limited-overs cricket analytics as Spark jobs.

Nested match documents become match and delivery tables, the tables become
features, reports, par scores, models and batch predictions.  Everything is a
function from DataFrame to DataFrame.
"""
