"""frameloom: framed-signal and paired-evaluation analytics on PySpark."""

__version__ = "0.1.0"
