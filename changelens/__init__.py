"""changelens: version-control history mining and text-corpus operators on PySpark."""
