"""leverscope: find out which inputs drive an outcome in a large Spark table.

profile -> prepare -> fit -> evaluate -> explain -> narrate -> govern, each step
a DataFrame operator.
"""

__version__ = "0.1.0"
