"""weblens: Spark-native structure analysis of raw HTML pages.

Entry points:
  weblens.plans.context   cached base tables (nodes, elements, texts) per input
  weblens.plans.registry  every registered query (name -> (spark, sf_dir) -> DataFrame)
  weblens.operators.*     the operators as DataFrame -> DataFrame functions
"""

__version__ = "0.1.0"
