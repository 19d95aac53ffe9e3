"""Tradewind: cleaning, data models and analyses for shop event data, as Spark DataFrame jobs.

Every public function takes DataFrames and plain parameters and returns DataFrames.
"""
