"""Clickstream analytics as plain DataFrame -> DataFrame functions on PySpark.

sources    reading, conforming, validating and laying out the raw event table
operators  sessions, funnels, daily metrics, cohort retention
functions  column helpers and the distributed exact median
plans      marts, dashboard data sets and chart feeds built from the operators
"""
