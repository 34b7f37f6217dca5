"""Frequency, severity and pure-premium models fitted on Spark.

Built-in Spark ML does the heavy lifting (GeneralizedLinearRegression for
Poisson / Gamma / Tweedie / Gaussian, LogisticRegression, trees, forests).
Negative binomial is IRLS where every step is a distributed weighted least
squares; the Tweedie density for the power profile is a pandas_udf summed
by Spark.  Only coefficients, levels and metrics reach the driver.
"""
