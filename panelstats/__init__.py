"""panelstats: repeated-questionnaire (panel) analytics on Spark DataFrames.

Sub-packages
------------
sources    scans, sinks, views, R-safe names, table profile
functions  column expressions: labels, composite scores, value picking
operators  code-books, panel split/qualify/pivot/spread, statistics,
           association (Pearson, Goodman-Kruskal gamma), regression
plans      the study's jobs as compositions, and the registered queries
streaming  the row-level operators applied to streaming DataFrames
"""

__version__ = "0.1.0"
