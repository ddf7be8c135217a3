"""Whole analyses: functions from input tables to result tables, with the SQL that they are checked against."""
