"""corpusloom: build and analyse labeled text corpora as Spark jobs.

Every operator takes DataFrames and returns lazy DataFrames. See README.md.
"""

__version__ = "0.1.0"
