"""Stratified Datalog compiled to DataFrames."""
