"""Onboarding and modelling of tabular sources as Spark DataFrame jobs.

scan -> land raw -> profile -> discover keys -> map -> load -> validate -> stage -> mart -> enrich -> test
"""
