"""stancekit: Spark-native toolkit for auditing sentence classification.

Plain functions ``DataFrame -> DataFrame`` (use with ``df.transform``) and
``Column -> Column`` expressions; Catalyst plans everything.
"""

__version__ = "0.1.0"
